"""Small tables with the awkward cases every operator must take, and brute-force versions."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pandas as pd

FOLDER = "/root/testdata/sf0.001"
# Extra columns whose names operators use inside.
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id string, key int, fp string, row int, "
          "n_words string, kept string, token_ids string, u int, size string, component int")


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def corpus(seed=7):
    """Rows with nulls, empty and long texts, copies, near copies, shared passages, repeated rows and clashing columns."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeiou") + rng.choice("rstlmn") for _ in range(rng.randint(1, 3))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    passage = prose(70)
    texts = [None, "", "   \n", "one two", prose(49), prose(50), prose(51)]
    long = prose(6000)
    texts += [long, long + " end", prose(80), passage]
    for i in range(30):
        texts.append(prose(rng.randint(20, 200)))
    for i in range(8):
        texts.append(prose(rng.randint(0, 60)) + " " + passage + "\n" + prose(rng.randint(0, 60)))
    base = prose(120)
    texts += [base] * 5
    for i in range(6):
        changed = base.split()
        changed[rng.randrange(120)] = "changed"
        texts.append("  ".join(changed))
    texts += ["# * $ % & " * 40 + prose(60), ("same line of words\n" * 30) + prose(20), prose(30) + " é 你好\x1c🎉 " + prose(40)]
    rows = []
    for i, text in enumerate(texts):
        rows.append((i * 3, text, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None]), len(text or ""),
                     "x", 1, "f", 2, "w", "k", "t", 3, "z", 4))
    rows += [rows[12], rows[12], rows[8]]
    rows.append((None, passage, "en", "s1", 5) + rows[0][5:])
    rows.append((None, None, None, None, None) + (None,) * 10)
    rows.append((9, prose(60), "en", "s2", 5) + rows[0][5:])
    rng.shuffle(rows)
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA).repartition(3)


def removed_brute(rows, window=50):
    """Per row: words, removed words and kept text."""
    seen = defaultdict(set)
    for r in rows:
        w = words(r[1])
        for p in range(len(w) - window + 1):
            if r[0] is not None:
                seen[tuple(w[p:p + window])].add(r[0])
    out = []
    for r in rows:
        w = words(r[1])
        gone = set()
        for p in range(len(w) - window + 1):
            if r[0] is not None and min(seen[tuple(w[p:p + window])]) < r[0]:
                gone.update(range(p, p + window))
        out.append((r[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def ppm_brute(rows, order):
    """Per (id, text): id, held out, tokens, known, train tokens, base score, score."""
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    tokens = [[w.decode() for w in (t or "").encode().lower().split()] + [None] for _, t in rows]
    data = [bytes([254]) * order + " ".join(t[:-1]).encode() + b"\xff" for t in tokens]
    trie, counts = defaultdict(Counter), Counter()
    for out, b, t in zip(held, data, tokens):
        if not out:
            counts.update(t)
            for p in range(order, len(b)):
                for k in range(order + 1):
                    trie[b[p - k:p]][b[p]] += 1

    def log_p(context, symbol):
        excluded, total = set(), 0.0
        for k in range(order, -1, -1):
            live = {a: n for a, n in trie.get(context[len(context) - k:], {}).items() if a not in excluded}
            if not live:
                continue
            room = sum(live.values())
            if symbol in live:
                return total + math.log10((live[symbol] - 0.5) / room)
            total += math.log10(0.5 * len(live) / room)
            excluded |= set(live)
        return total - math.log10(255 - len(excluded))

    n, kinds = sum(counts.values()), len(counts)
    for context in list(trie)[:20]:
        if len(context) == order:
            assert abs(sum(10 ** log_p(context, s) for s in range(256) if s != 254) - 1) < 1e-9
    return [(i, out, len(t), sum(counts[x] > 0 for x in t), n, sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (kinds + 1))) for x in t),
             sum(log_p(b[p - order:p], b[p]) for p in range(order, len(b)))) for (i, _), out, t, b in zip(rows, held, tokens, data)]


def groups_brute(prints, radius=4):
    """Root row number per fingerprint."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def table(name, folder=FOLDER):
    return pd.read_parquet(f"{folder}/{name}.parquet")

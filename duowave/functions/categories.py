"""Groups, declared levels, score bands and result labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Study arms and visit labels, reference first.
CONTROL, INTERVENTION = "Control", "Intervention"
GROUPS = (CONTROL, INTERVENTION)
TIMES = ("pre", "post")

# Burden bands (upper bounds, inclusive) and depression bands.
BURDEN_BOUNDS = (20, 40, 60)
BURDEN_LABELS = ("keine/geringe", "leicht", "moderat", "schwer")
DEPRESSION_BANDS = (("minimal", 13), ("leicht", 19), ("moderat", 28))
DEPRESSION_TOP = ("schwer", 29)
DEPRESSION_LABELS = ("minimal", "leicht", "moderat", "schwer")

# Display names of model terms.
TERM_LABELS = {
    "who5_pre": "WHO-5 well-being (baseline)",
    "bdi_pre": "Depression (BDI, baseline)",
    "group_num": "Intervention group",
    "age": "Age (years)",
    "sexWeiblich": "Female sex",
    "marital_statusVerheiratet/ eingetragene Lebenspartnerschaft": "Married / civil partnership",
    "marital_statusVerwitwet": "Widowed",
    "educationHauptschulabschluss": "Primary education",
    "educationRealschulabschluss": "Secondary education",
    "rel_to_patientLebenspartner / Ehemann": "Partner / husband",
    "rel_to_patientLebenspartnerin / Ehefrau": "Partner / wife",
    "rel_to_patientTochter / Sohn": "Daughter / son",
    "years_known": "Years known to patient",
    "same_householdTRUE": "Same household",
    "n_children": "Number of children",
    "n_children_u21": "Children under 21",
    "n_adult_care": "Adults cared for",
    "years_care": "Years of caregiving",
    "employedTRUE": "Currently employed",
    "work_hours": "Weekly work hours",
}

# Display names of moderators.
MODERATOR_LABELS = {
    "who5_pre": "Well‑being (WHO‑5)",
    "bdi_pre": "Depression (BDI)",
    "age": "Age (years)",
    "sexWeiblich": "Sex (female)",
    "marital_statusVerheiratet/ eingetragene Lebenspartnerschaft": "Married / partnered",
    "marital_statusVerwitwet": "Widowed",
    "educationHauptschulabschluss": "Primary education",
    "educationRealschulabschluss": "Secondary education",
    "rel_to_patientLebenspartner / Ehemann": "Partner / husband",
    "rel_to_patientLebenspartnerin / Ehefrau": "Partner / wife",
    "rel_to_patientTochter / Sohn": "Daughter / son",
    "years_known": "Years known to patient",
    "same_householdTRUE": "Same household",
    "n_children": "Number of children",
    "n_children_u21": "Children under 21",
    "n_adult_care": "Adults cared for",
    "care_level": "Patient care‑level",
    "years_care": "Years of caregiving",
    "employedTRUE": "Employed",
    "work_hours": "Weekly work hours",
    "worktime_reducedTRUE": "Reduced work hours",
}


def group_label(active: Column | str) -> Column:
    """Study arm of an activity flag; a missing flag means control."""
    flag = F.col(active) if isinstance(active, str) else active
    return F.when(F.coalesce(flag, F.lit(False)), INTERVENTION).otherwise(CONTROL)


def group_dummy(group: Column | str) -> Column:
    """1 for the intervention arm, 0 for all else."""
    name = F.col(group) if isinstance(group, str) else group
    return F.coalesce((name == INTERVENTION).cast("int"), F.lit(0))


def with_levels(df: DataFrame, name: str, levels: Sequence[str], ordinal: str | None = None) -> DataFrame:
    """Keep only declared levels of a column; ``ordinal`` names an extra column with the level's position."""
    kept = {name: F.when(F.col(name).isin(*levels), F.col(name))}
    if ordinal:
        kept[ordinal] = level_position(F.col(name), levels)
    return df.withColumns(kept)


def level_position(c: Column, levels: Sequence[str]) -> Column:
    """1-based position of a level, NULL when undeclared."""
    return F.nullif(F.array_position(F.array(*map(F.lit, levels)), c).cast("int"), F.lit(0))


def bin_right_closed(c: Column | str, bounds: Sequence[float] = BURDEN_BOUNDS,
                     labels: Sequence[str] = BURDEN_LABELS) -> Column:
    """Label of the right-closed interval that holds the value."""
    x = F.col(c) if isinstance(c, str) else c
    result = F.when(x <= bounds[0], labels[0])
    for bound, label in zip(bounds[1:], labels[1:]):
        result = result.when(x <= bound, label)
    return result.when(x > bounds[-1], labels[-1])


def severity_class(c: Column | str) -> Column:
    """Depression band of a total; NULL between the top two bands."""
    x = F.col(c) if isinstance(c, str) else c
    result = F.when(x <= DEPRESSION_BANDS[0][1], DEPRESSION_BANDS[0][0])
    for label, bound in DEPRESSION_BANDS[1:]:
        result = result.when(x <= bound, label)
    return result.when(x >= DEPRESSION_TOP[1], DEPRESSION_TOP[0])


def significance_label(p: Column | str) -> Column:
    """``p < .01``, ``p < .05`` or ``n.s.``."""
    value = F.col(p) if isinstance(p, str) else p
    return F.when(value < 0.01, "p < .01").when(value < 0.05, "p < .05").otherwise("n.s.")


def readable_term(term: Column, predictor: Column) -> Column:
    """``predictor: level`` for a factor term, blanks in place of underscores."""
    level = F.when(term.startswith(predictor), F.expr("substring(term, length(predictor) + 1)")).otherwise(term)
    text = F.when(term == predictor, predictor).otherwise(F.concat(predictor, F.lit(": "), level))
    return F.replace(text, F.lit("_"), F.lit(" "))


def mapped_label(c: Column, labels: Mapping[str, str], default: Column) -> Column:
    """Display name of ``c``, ``default`` where none is listed."""
    pairs = [F.lit(x) for pair in labels.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), default) if pairs else default


def interaction_side(term: Column) -> Column:
    """The part of an interaction term that is not the group."""
    return F.trim(
        F.when(term.startswith("group"), F.regexp_replace(term, r"^group[^:]*:", ""))
        .otherwise(F.regexp_replace(term, r":group[^:]*$", ""))
    )


def signif(x: Column, digits: int = 3) -> Column:
    """Round to significant digits."""
    scale = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x / scale, digits - 1) * scale)

"""The whole study: exports in, result tables out.

Scored visits, the long outcomes and the pre/post pairs are written when a report first asks for them, so a questionnaire
is scored once for all reports that use its scores, and not at all for those that do not. The baseline table scores
its forms by a rule of its own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duowave.functions import categories as cat
from duowave.functions import dates, text
from duowave.functions.names import first_present_column, present_columns, standardize_id
from duowave.operators import (
    anova, diagnostics, effects, elastic_net, imputation, joins, linear, mice, mixed_counts, ranking, reshape, response, scoring,
    summary, visits,
)
from duowave.plans.instruments import BURDEN, DEPRESSION, INSTRUMENTS, WELLBEING, Instrument, score_form
from duowave.plans.scratch import Scratch
from duowave.sources.exports import read_export, write_csv, write_table

# Columns of the case report form that hold sex and marital status, best first.
SEX_COLUMNS = ("id2_2_ihr_geschlecht", "geschlecht", "sex", "gender", "biologisches_geschlecht", "sexus")
MARITAL_COLUMNS = ("id3_3_ihr_familienstand", "familienstand", "family_status", "marital_status")

# Predictors from the case report form and their columns.
NUMERIC_PREDICTORS = {
    "age": "id1_1_ihr_alter",
    "years_known": "id85_11_wie_lange_kennen_sie_schon_die_patientin_den_patienten_in_jahren",
    "n_children": "id24_15_1_fur_wie_viele_im_haushalt_lebende_kinder",
    "n_children_u21": "id25_15_1_1_fur_wie_viele_kinder_unter_21_jahren",
    "n_adult_care": "id26_15_2_fur_wie_viele_im_haushalt_lebende_pflegebedurftige_erwachsene",
    "care_level": "id22_14_welchen_pflegegrad_hat_die_patientin_der_patient",
    "years_care": "id89_13_seit_wie_vielen_jahren_pflegen_sie_die_patientin_den_patienten",
    "work_hours": "id117_wie_viele_stunden_sind_s_ie_in_der_woche_erwerbstatig_angabe_als_dezimalzahl_z_b_1_5",
}
FACTOR_PREDICTORS = {
    "sex": "id2_2_ihr_geschlecht",
    "marital_status": "id3_3_ihr_familienstand",
    "education": "id4_4_ihr_hochster_schulabschluss",
    "rel_to_patient": "id9_8_welche_beziehung_haben_sie_zur_patientin_zum_patienten_sind_sie",
    "same_household": "id16_12_leben_sie_mit_der_patientin_dem_patienten_in_einem_haushalt_zusammen",
    "employed": "id52_23_sind_sie_selbst_derzeit_erwerbstatig",
    "worktime_reduced": "id60_haben_sie_im_letzten_monat_ihre_wochentliche_arbeitszeit_wegen_ihrer_pflegerischen_aufgaben_verkurzt",
}

# Missing items tolerated in the baseline scores, which sum observed items only.
BASELINE_TOLERANCE = {"ZBI": 4, "BDI-II": 2}


def study_groups(patients: DataFrame, active: str = "active") -> DataFrame:
    """Patient id and study arm."""
    return standardize_id(patients).select("patient_id", cat.group_label(active).alias("group"))


def scored_visits(form: DataFrame, instrument: Instrument, seq_col: str = "ingest_seq") -> DataFrame | None:
    """Dated scores of one questionnaire; ``None`` when the form lacks its items."""
    scored = score_form(standardize_id(form, out="patient"), instrument)
    if scored is None:
        return None
    timed = visits.get_when(scored, seq_col, "patient")
    return timed.select("patient", "when_dt", F.col(seq_col).alias("tie"), "score_raw", "score_imp", "score")


def long_outcomes(scored: Mapping[str, DataFrame | None], groups: DataFrame) -> DataFrame:
    """First and last visit per patient and instrument with score and arm, from scored visits; arms join the reduced rows."""
    rows = reshape.stack_instruments(scored).select("patient", "instrument", "when_dt", "tie", "score")
    ends = visits.add_pre_post(rows, ["patient", "instrument"], "when_dt", "tie")
    return joins.join_group(ends, groups).select("patient", "instrument", "time", "score", "when_dt", "group")


class Study:
    """Outcomes of all questionnaires of a study, ready for its reports."""

    def __init__(self, patients: DataFrame, forms: Mapping[str, DataFrame], crf: DataFrame | None = None,
                 seq_col: str = "ingest_seq", instruments: Sequence[Instrument] = INSTRUMENTS, dedup: bool = True):
        """``dedup=False`` keeps all different case report forms of a patient, which multiplies rows joined with them."""
        self.spark = patients.sparkSession
        self.scratch = Scratch(self.spark, "study")
        self.forms, self.crf, self.seq_col, self.instruments = dict(forms), crf, seq_col, instruments
        self.dedup = dedup
        self.groups = study_groups(patients)
        self._scored: dict[str, DataFrame | None] = {}

    def scored(self, instrument: Instrument) -> DataFrame | None:
        """Dated scores of one questionnaire, computed once; ``None`` when its form lacks the items."""
        if instrument.name not in self._scored:
            made = scored_visits(self.forms[instrument.name], instrument, self.seq_col)
            self._scored[instrument.name] = made if made is None else self.scratch.write(made, f"scored_{len(self._scored)}")
        return self._scored[instrument.name]

    @cached_property
    def long(self) -> DataFrame:
        """First and last visit per patient and instrument."""
        scored = {i.name: self.scored(i) for i in self.instruments if i.name in self.forms}
        return self.scratch.write(long_outcomes(scored, self.groups), "long")

    @cached_property
    def pairs(self) -> DataFrame:
        """Pre, post and change per patient and instrument."""
        wide = reshape.pivot_pre_post(self.long, ["patient", "instrument", "group"])
        return self.scratch.write(reshape.change_score(wide), "pairs")

    def remove(self) -> None:
        """Delete the study's written tables; its reports cannot be computed from them afterwards."""
        self.scratch.remove()
        self._scored.clear()
        for name in ("long", "pairs"):
            self.__dict__.pop(name, None)

    # --- baseline characteristics ---

    def attributes(self) -> DataFrame:
        """Age, sex and marital status, one row per patient from the latest case report form (or all different rows)."""
        crf = standardize_id(self.crf)
        age = summary.pick_plausible_column(crf)
        sex = first_present_column(crf, SEX_COLUMNS) or summary.find_column_by_token(crf.drop("patient_id"))
        marital = first_present_column(crf, MARITAL_COLUMNS)
        none = F.lit(None).cast("string")
        latest = self._latest_form(crf, "patient_id")
        rows = latest.select(
            "patient_id", (text.to_numeric(age) if age else none.cast("double")).alias("alter"),
            (text.canon_sex(sex) if sex else none).alias("geschlecht"),
            (text.canon_marital(marital) if marital else none).alias("familienstand"),
        )
        return rows if self.dedup else rows.distinct()

    def _latest_form(self, form: DataFrame, key: str) -> DataFrame:
        if not self.dedup:
            return form
        timed = visits.get_when(form, self.seq_col, key)
        return visits.latest_per_cell(timed, [key], "when_dt", self.seq_col)

    def baseline_rows(self) -> DataFrame:
        """Earliest burden form per patient with the depression total of the same day and the attributes."""
        def observed(instrument: Instrument, out: str) -> DataFrame:
            form = standardize_id(self.forms[instrument.name])
            items = instrument.item_columns(form)
            coded = scoring.code_items(form, items, instrument.codes or text.DEPRESSION_CODES)
            score = scoring.score_observed(items, BASELINE_TOLERANCE[instrument.name])
            return coded.select("patient_id", "authored", self.seq_col, score.alias(out))

        rows = observed(BURDEN, "zbi_total_raw")
        if DEPRESSION.name in self.forms:
            rows = joins.join_two_keys(rows, observed(DEPRESSION, "bdi_total_raw").drop(self.seq_col),
                                       ["patient_id", "authored"])
        timed = visits.get_when(rows, self.seq_col, "patient_id")
        first = visits.baseline_row(timed, ["patient_id"], "when_dt", self.seq_col)
        parts = [self.groups] if self.crf is None else [self.attributes(), self.groups]
        return joins.join_chain(first, parts, "patient_id").withColumn(
            "zbi_kat_raw", cat.bin_right_closed("zbi_total_raw")
        )

    def baseline_table(self) -> DataFrame:
        """Characteristics at baseline by arm."""
        rows = self.baseline_rows()
        levels = {"zbi_kat_raw": cat.BURDEN_LABELS}
        if "bdi_total_raw" in rows.columns:
            rows = rows.withColumn("bdi_kat_raw", cat.severity_class("bdi_total_raw"))
            levels["bdi_kat_raw"] = cat.DEPRESSION_LABELS
        if self.crf is not None:
            levels |= {"geschlecht": text.SEX_LEVELS, "familienstand": text.MARITAL_LEVELS}
        return summary.baseline_table(rows, present_columns(rows, ["zbi_total_raw", "bdi_total_raw", "alter"]), levels)

    # --- outcomes ---

    def unparsed_times(self) -> DataFrame:
        """Per form and time column the known values that give no time, whose rows have no visit time of their own."""
        found = [dates.unparsed_times(form, columns).withColumn("form", F.lit(name)) for name, form in self.forms.items()
                 if (columns := present_columns(form, visits.TIME_COLUMNS))]
        return reshape.bind_results(found, self.spark, T.StructType([
            T.StructField("column_name", T.StringType()), T.StructField("n_known", T.LongType()),
            T.StructField("n_unparsed", T.LongType()), T.StructField("form", T.StringType())]))

    def missing_scores(self, instrument: Instrument = BURDEN) -> DataFrame:
        """Missing raw, imputed and preferred scores of one questionnaire."""
        return summary.missing_summary(self.scored(instrument), "score_raw", "score_imp", "score")

    def anova(self) -> DataFrame:
        """Group x time tests per instrument."""
        return anova.mixed_anova(self.pairs)

    def changes(self, instrument: str = BURDEN.name) -> DataFrame:
        """Change per patient, largest first, with an empty column for review notes."""
        rows = self.pairs.where(F.col("instrument") == instrument).withColumn("review_note", F.lit(None).cast("string"))
        return ranking.rank_changes(rows.select("patient", "group", "pre", "post", "change", "review_note"))

    def means(self) -> DataFrame:
        """Mean and standard error per instrument, arm and visit."""
        return summary.mean_se(self.long)

    def residuals(self) -> DataFrame:
        """Normality of the residuals."""
        return diagnostics.residual_diagnostics(self.long)

    def shapiro(self) -> DataFrame:
        """Shapiro-Wilk test of the residuals."""
        return diagnostics.shapiro_wilk(self.long)

    def count_models(self) -> DataFrame:
        """Negative-binomial models of group x time with a random intercept per patient."""
        return mixed_counts.nb_mixed_model(self.long)

    # --- sensitivity ---

    def regression_imputed_pairs(self, instrument: Instrument = BURDEN) -> DataFrame:
        """Pairs of one instrument after filling missing raw totals with their arm's mean."""
        rows = joins.join_group(self.scored(instrument), self.groups)
        filled = imputation.regression_impute(rows, "score_raw", out="total").withColumn("instrument", F.lit(instrument.name))
        pairs = visits.pre_post_pairs(filled.select("patient", "instrument", "when_dt", "tie", "total"),
                                      ["patient", "instrument"], "when_dt", "tie", "total")
        return joins.join_group(pairs, self.groups)

    def effect_sizes(self) -> DataFrame:
        """Within-group and between-group effects of the regression-imputed burden scores."""
        return effects.effect_table(self.regression_imputed_pairs())

    def outlier_sensitivity(self, n: int = 2, ties: bool = False) -> DataFrame:
        """The group:time test with and without the largest changes."""
        return anova.anova_without_outliers(self.pairs, n, ties)

    # --- response ---

    def responses(self) -> DataFrame:
        """Responder and worsener flags of all instruments with a response rule."""
        rules = {i.name: (i.better, i.mcid) for i in self.instruments if i.mcid or i is BURDEN}
        return response.classify_response(self.pairs, response.mcid_threshold(self.pairs, rules))

    def responder_rates(self) -> DataFrame:
        """Response per instrument and arm."""
        return response.responder_rates(self.responses())

    def odds(self) -> DataFrame:
        """Logistic regression of response on arm."""
        return response.logit_or(self.responses())

    # --- predictors ---

    def predictor_rows(self) -> DataFrame:
        """Baseline scores, change, arm and case report form predictors, one row per patient with a burden baseline."""
        scores = joins.pick_scores(self.long, "patient", {
            "zbi_pre": (BURDEN.name, "pre"), "zbi_post": (BURDEN.name, "post"),
            "who5_pre": (WELLBEING.name, "pre"), "bdi_pre": (DEPRESSION.name, "pre"),
        }).where(F.col("zbi_pre").isNotNull())
        rows = joins.join_group(scores, self.groups).withColumns({
            "delta_zbi": F.col("zbi_post") - F.col("zbi_pre"),
            "group_num": cat.group_dummy("group").cast("double"),
        })
        if self.crf is None:
            return rows
        crf = self._latest_form(standardize_id(self.crf, out="patient"), "patient")
        return joins.join_chain(rows, [crf.select(
            "patient",
            *[text.to_numeric(c).alias(p) for p, c in NUMERIC_PREDICTORS.items() if c in crf.columns],
            *[F.col(c).cast("string").alias(p) for p, c in FACTOR_PREDICTORS.items() if c in crf.columns],
        )], "patient")

    def predictors(self) -> DataFrame:
        """All univariate models of baseline and change, and the moderator interactions."""
        rows = self.scratch.write(self.predictor_rows(), "predictors")
        numeric = present_columns(rows, ["who5_pre", "bdi_pre", *NUMERIC_PREDICTORS])
        factors = present_columns(rows, list(FACTOR_PREDICTORS))
        results = [linear.moderator_numeric(rows, numeric, "zbi_pre", "zbi_post")]
        # Both outcomes in one pass over the rows; the model is named by its outcome.
        models = F.when(F.col("outcome") == "zbi_pre", "Baseline ZBI (univariate)").otherwise("Delta ZBI (univariate)")
        outcomes = ["zbi_pre", "delta_zbi"]
        results.append(linear.uni_lm_numeric(rows, outcomes, [*numeric, "group_num"]).withColumn("model", models))
        if factors:
            results.append(linear.uni_lm_factor(rows, outcomes, factors).withColumn("model", models))
        if factors:
            results.append(linear.moderator_factor(rows, factors, "zbi_pre", "zbi_post"))
        return linear.predictor_report(*results)

    def moderator_net(self, rule: str = "is_1se") -> DataFrame | None:
        """Terms of the elastic-net model of the burden at the last visit; ``None`` without predictors."""
        rows = self.scratch.write(self.predictor_rows(), "net")
        numeric = present_columns(rows, ["who5_pre", "bdi_pre", *NUMERIC_PREDICTORS])
        factors = present_columns(rows, list(FACTOR_PREDICTORS))
        if not numeric and not factors:
            return None
        path, terms = elastic_net.moderator_net(rows, numeric, factors, "zbi_pre", "zbi_post")
        return elastic_net.net_coefficients(path, terms, rule=rule)

    # --- multiple imputation ---

    def wide_scales(self) -> DataFrame:
        """One row per patient with all scales at both visits; patients without arm are left out."""
        wide = reshape.all_scales_wide(self.long, "patient", self._scale_names())
        return joins.join_group(wide, self.groups).where(F.col("group").isNotNull())

    def _scale_names(self) -> dict[str, str]:
        short = {BURDEN.name: "zbi", WELLBEING.name: "who5", DEPRESSION.name: "bdi"}
        return {i.name: short.get(i.name, i.name.lower()) for i in self.instruments if i.name in self.forms}

    def imputed_effects(self, m: int = mice.COPIES, rounds: int = mice.ROUNDS) -> DataFrame:
        """Pooled effect of the arm on change over multiply-imputed copies."""
        wide = self.wide_scales()
        names = self._scale_names()
        cells = [f"{s}_{t}" for s in names.values() for t in cat.TIMES]
        rows = self.scratch.write(
            scoring.keep_any_observed(wide, cells).withColumn("group_num", cat.group_dummy("group").cast("double")), "wide"
        )
        copies = mice.mice_pmm(rows, "patient", ["group_num", *cells], m, rounds)
        scales = F.array(*[
            F.struct(F.lit(i).alias("instrument"), F.col(f"{s}_pre").alias("pre"), F.col(f"{s}_post").alias("post"))
            for i, s in names.items()
        ])
        group = F.when(F.col("group_num") == 1, cat.INTERVENTION).otherwise(cat.CONTROL)
        long = copies.select("imp", group.alias("group"), F.explode(scales).alias("s")).select("imp", "group", "s.*")
        return imputation.rubin_pool(imputation.mi_delta_fit(long))

    # --- everything ---

    def write_reports(self, folder: str, m: int = mice.COPIES, rounds: int = mice.ROUNDS) -> list[str]:
        """Write all report tables as CSV folders and the row-scale tables as Parquet; returns the report names."""
        predictors = self.scratch.write(self.predictors(), "report")
        odds = self.scratch.write(self.odds(), "odds")
        reports = {
            "baseline_table": self.baseline_table(),
            "score_missing": self.missing_scores(),
            "unparsed_times": self.unparsed_times(),
            "anova": anova.anova_report(self.anova()),
            "score_means": self.means(),
            "residual_diagnostics": self.residuals(),
            "residual_shapiro": self.shapiro(),
            "count_models": self.count_models(),
            "effect_sizes": self.effect_sizes(),
            "outlier_sensitivity": self.outlier_sensitivity(),
            "responder_rates": self.responder_rates(),
            "response_logit": odds,
            "response_odds": response.odds_ratio_table(odds),
            "predictors": predictors,
            "moderators": predictors.where(F.col("model") == "Moderator ANCOVA"),
            "forest": linear.forest_table(predictors),
            "imputed_effects": self.imputed_effects(m, rounds),
        }
        net = self.moderator_net()
        if net is not None:
            reports["moderator_net"] = net
        for name, table in reports.items():
            write_csv(table, f"{folder}/{name}")
        write_table(self.pairs, f"{folder}/pairs")
        write_table(self.wide_scales(), f"{folder}/wide_scales")
        write_csv(self.changes(), f"{folder}/burden_changes")
        return [*reports, "burden_changes"]


def read_study(spark: SparkSession, patients: str, forms: Mapping[str, str], crf: str | None = None,
               multi_line: bool = True, dedup: bool = True) -> Study:
    """A study from CSV exports: the patient table, one export per instrument name and the case report form.

    The case report form also serves the fatigue items unless an export is named for them. ``multi_line=False`` splits
    large files whose cells hold no line breaks.
    """
    people = read_export(spark, patients, multi_line=multi_line)
    people = people.withColumn("active", F.lower(F.col("active").cast("string")).isin("true", "t"))
    tables = {name: read_export(spark, path, multi_line=multi_line) for name, path in forms.items()}
    case = read_export(spark, crf, multi_line=multi_line) if crf else None
    if case is not None:
        tables.setdefault("CRF", case)
    return Study(people, tables, case, dedup=dedup)

"""Word and character error rates over a corpus, and the comparison of two systems."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.functions.distance import word_distance
from corpusflow.functions.text import char_units, collapsed, normalized_basic, normalized_loose

FORMS = {"": lambda c: F.coalesce(c, F.lit("")), "normalized_": normalized_basic, "loose_": normalized_loose}


def pair_errors(df: DataFrame, reference: str, hypothesis: str | Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Per row the edits and reference units of the six metrics: words and characters of three forms.

    ``hypothesis`` is a column, or several by the prefix of their figures; the reference's
    forms are made once for all of them. Forms, units and distances are three projections,
    so no pattern runs twice for a row; equal units need no distance.
    """
    sides = {"r": reference} | ({"": hypothesis} if isinstance(hypothesis, str) else dict(hypothesis))
    sides = {f"_{k}": c for k, c in sides.items()}
    forms = df.select(*keep, *(form(F.col(c)).alias(f"{p}{k}") for p, form in FORMS.items() for k, c in sides.items()))
    units = [u.alias(f"{p}{name}{k}") for p in FORMS for k in sides for u, name in ((F.col(f"{p}{k}") if p else collapsed(F.col(k)), "w"), (char_units(F.col(f"{p}{k}")), "c"))]
    split = forms.select(*keep, *units)

    def n_words(text: Column) -> Column:
        return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("bigint")

    columns: dict[str, Column] = {}
    for k in list(sides)[1:]:
        for p in FORMS:
            rw, hw, rc, hc = (F.col(f"{p}{name}{side}") for name in "wc" for side in ("_r", k))
            columns |= {
                f"{k[1:]}{p}wer_edits": word_distance(rw, hw),
                f"{k[1:]}{p}wer_units": n_words(rw),
                f"{k[1:]}{p}wer_other": n_words(hw),
                f"{k[1:]}{p}cer_edits": F.when(rc == hc, F.lit(0)).otherwise(F.levenshtein(rc, hc)).cast("bigint"),
                f"{k[1:]}{p}cer_units": F.length(rc).cast("bigint"),
                f"{k[1:]}{p}cer_other": F.length(hc).cast("bigint"),
            }
    return split.select(*keep, *(c.alias(name) for name, c in columns.items()))


def rate(edits: Column, units: Column, other: Column) -> Column:
    """Edits per reference unit; without reference units 0 if the hypothesis is empty too, else 1."""
    return F.when(units > 0, edits / units).when(other > 0, 1.0).otherwise(0.0)


def _summed(errors: DataFrame, groups: Sequence[str], prefixes: Sequence[str]) -> tuple[DataFrame, list[str]]:
    names = [f"{p}{m}" for p in FORMS for m in ("wer", "cer")]
    parts = [f"{x}{n}_{part}" for x in prefixes for n in names for part in ("edits", "units", "other")]
    return errors.groupBy(*groups).agg(*(F.coalesce(F.sum(part), F.lit(0)).alias(part) for part in parts)), names


def _rate_of(name: str) -> Column:
    return rate(*(F.col(f"{name}_{part}") for part in ("edits", "units", "other")))


def corpus_metrics(errors: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """``metric, edits, units, value`` of the six metrics, micro-averaged, in one pass; per group if given."""
    total, names = _summed(errors, groups, [""])
    cells = F.array(*(F.struct(F.lit(n).alias("metric"), F.col(f"{n}_edits").alias("edits"), F.col(f"{n}_units").alias("units"), _rate_of(n).alias("value")) for n in names))
    return total.select(*groups, F.inline(cells))


def compared(errors: DataFrame, base: str = "base_", tuned: str = "tuned_") -> DataFrame:
    """Absolute and relative improvement per metric, from the errors of two hypotheses in one pass; relative is null where the base is 0."""
    total, names = _summed(errors, [], [base, tuned])
    cells = F.array(*(F.struct(F.lit(n).alias("metric"), _rate_of(base + n).alias("base"), _rate_of(tuned + n).alias("tuned")) for n in names))
    gain = F.col("base") - F.col("tuned")
    return total.select(F.inline(cells)).select("metric", "base", "tuned", gain.alias("absolute"), (gain / F.nullif("base", F.lit(0.0))).alias("relative"))


# Columns of a prediction, those of a tuned one, the states, and the fields that are one value in a file.
PREDICTION_COLUMNS = ("uid", "reference", "prediction", "model_name", "model_family", "tuned_or_base", "run_name", "config_hash")
TUNED_COLUMNS = ("tuned_adapter_path", "training_config_hash")
STATES = ("base", "tuned")
CONSTANT_COLUMNS = ("model_name", "model_family", "tuned_or_base", "run_name", "config_hash")


def contract_faults(df: DataFrame) -> DataFrame:
    """One row with the faults of a file of predictions, all zero or blank where it keeps the contract.

    ``n_rows, is_empty``; ``n_missing``, rows without a column that their state needs, a null
    being missing, with ``missing_columns`` naming them; ``n_bad_state``; ``varying_columns``
    and ``empty_columns``, constant fields with several values or with the empty text.
    """
    none = F.lit(None).cast("string")
    cell = {c: F.col(c).cast("string") if c in df.columns else none for c in (*PREDICTION_COLUMNS, *TUNED_COLUMNS)}
    is_tuned = F.coalesce(cell["tuned_or_base"] == "tuned", F.lit(False))
    lacks = {c: cell[c].isNull() if c in PREDICTION_COLUMNS else is_tuned & cell[c].isNull() for c in cell}
    some = F.exists(F.array(*lacks.values()), lambda x: x)
    return df.agg(
        F.count("*").alias("n_rows"),
        (F.count("*") == 0).alias("is_empty"),
        F.count_if(some).alias("n_missing"),
        F.concat_ws(",", *(F.when(F.count_if(x) > 0, F.lit(c)) for c, x in sorted(lacks.items()))).alias("missing_columns"),
        F.count_if(~F.coalesce(cell["tuned_or_base"].isin(*STATES), F.lit(False))).alias("n_bad_state"),
        F.concat_ws(",", *(F.when(F.count_distinct(F.coalesce(cell[c], F.lit("None"))) > 1, F.lit(c)) for c in CONSTANT_COLUMNS)).alias("varying_columns"),
        F.concat_ws(",", *(F.when(F.count_if(cell[c] == "") > 0, F.lit(c)) for c in CONSTANT_COLUMNS)).alias("empty_columns"),
    )


def prediction_health(df: DataFrame, prediction: str, key: str, duration: str, n: int = 20) -> DataFrame:
    """Rows, empty predictions, hours, and the first ``n`` keys of empty predictions; no more than ``n`` keys are held."""
    empty = F.trim(F.coalesce(F.col(prediction), F.lit(""))) == ""
    marked = df.withColumn("_empty", empty)
    first = marked.filter("_empty").select(key).orderBy(key).limit(n).agg(F.array_sort(F.collect_list(key)).alias("first_empty"))
    counts = marked.agg(F.count("*").alias("n_rows"), F.count_if("_empty").alias("n_empty"), (F.sum(F.col(duration).cast("double")) / 3600.0).alias("hours"))
    return counts.withColumn("first_empty", first.scalar())


def best_epoch(history: DataFrame, epoch: str, metric: str, patience: int) -> DataFrame:
    """``best_epoch, best_value, stopped_epoch``: training stops after ``patience`` epochs in a row without a lower value."""
    order = Window.orderBy(epoch)  # a training history is short
    before = F.min(metric).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = history.withColumn("_better", F.coalesce(F.col(metric) < before, F.lit(True)))
    last = F.max(F.when(F.col("_better"), F.col(epoch))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("_waited", F.col(epoch) - last)
    stop = F.min(F.when(F.col("_waited") >= patience, F.col(epoch))).over(Window.partitionBy())
    ran = marked.withColumn("_stop", F.coalesce(stop, F.max(epoch).over(Window.partitionBy()))).filter(F.col(epoch) <= F.col("_stop"))
    return ran.agg(F.min_by(epoch, F.struct(metric, epoch)).alias("best_epoch"), F.min(metric).alias("best_value"), F.max("_stop").alias("stopped_epoch"))

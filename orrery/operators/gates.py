"""Validation gates: each gives a report of what it checks; `enforce` turns a failed report into an error."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class GateError(ValueError):
    """A check that must hold does not."""


def enforce(report: DataFrame, name: str) -> dict:
    """The report's one row as a dict; an error if a column that counts violations (n_bad...) is not 0, if none counts any, or
    without a row: what checks nothing has not passed."""
    first = report.first()
    row = first.asDict() if first else {}
    if not any(k.startswith("n_bad") for k in row):
        raise GateError(f"{name}: nothing is checked")
    bad = {k: v for k, v in row.items() if k.startswith("n_bad") and v}
    if bad:
        raise GateError(f"{name}: {bad}")
    return row


def label_identity(labels: DataFrame) -> DataFrame:
    """n_rows, n_barcodes, n_bad_sample, n_bad_patient, n_bad_label, n_bad_null: barcodes in several samples, of several
    patients, with several labels, and rows without a barcode, sample, patient or label."""
    null = F.col("barcode").isNull() | F.col("sample").isNull() | F.col("patient").isNull() | F.col("label").isNull()
    by = labels.where("barcode is not null").groupBy("barcode").agg(*(F.count_distinct(c).alias(c) for c in ("sample", "patient", "label")))
    counts = by.agg(F.count("*").alias("n_barcodes"), *(F.count_if(F.col(c) > 1).alias(f"n_bad_{c}") for c in ("sample", "patient", "label")))
    return labels.agg(F.count("*").alias("n_rows"), F.count_if(null).alias("n_bad_null")).crossJoin(counts)


def marker_scores(scores: DataFrame, columns: list[str]) -> DataFrame:
    """n_rows, n_bad_<c> for each column: scores that are null, NaN or infinite."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return scores.agg(F.count("*").alias("n_rows"), *(F.count_if(bad(c)).alias(f"n_bad_{c}") for c in columns))


def same_sets(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """n_common, n_bad_left, n_bad_right: keys in both, and in one alone."""
    a, b = one.select(key).distinct().withColumn("a", F.lit(1)), two.select(key).distinct().withColumn("b", F.lit(1))
    return a.join(b, key, "full_outer").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_common"), F.count_if(F.col("b").isNull()).alias("n_bad_left"), F.count_if(F.col("a").isNull()).alias("n_bad_right"))


def tables_agree(one: DataFrame, two: DataFrame, key: str, columns: list[str], tolerance: float = 0.0) -> DataFrame:
    """n_rows, n_bad_missing, n_bad_<c>: rows of either table without a partner, and values that differ by more than tolerance times the larger."""
    a = one.select(key, *(F.col(c).alias(f"a_{c}") for c in columns), F.lit(1).alias("a"))
    b = two.select(key, *(F.col(c).alias(f"b_{c}") for c in columns), F.lit(1).alias("b"))
    def differ(c):
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        return F.abs(x - y) > tolerance * F.greatest(F.abs(x), F.abs(y)) if tolerance else ~x.eqNullSafe(y)
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return a.join(b, key, "full_outer").agg(F.count("*").alias("n_rows"), F.count_if(~both).alias("n_bad_missing"), *(F.count_if(both & F.coalesce(differ(c), F.col(f"a_{c}").isNull() != F.col(f"b_{c}").isNull())).alias(f"n_bad_{c}") for c in columns))


def donor_unit(df: DataFrame, donor_map: DataFrame | None) -> DataFrame:
    """df with unit and donor_verified: donors where a map names them all, else specimens."""
    known = donor_map is not None
    return df.withColumn("unit", F.lit("donor" if known else "specimen")).withColumn("donor_verified", F.lit(known))


def whole_source(coverage: DataFrame) -> DataFrame:
    """n_samples, n_labels, n_exact, n_bad_absent over a coverage table."""
    return coverage.agg(F.count("*").alias("n_samples"), F.sum("n_labels").alias("n_labels"), F.sum("n_exact").alias("n_exact"), F.sum("n_absent").alias("n_bad_absent"))


def compare(expected, observed, tolerance: float = 0.0, path: str = "", ignore: frozenset[str] = frozenset()) -> list[str]:
    """Differences between two nested results: missing and extra fields alike, numbers beyond the relative tolerance, NaN of any kind.

    Fields whose names start with log_p are compared by absolute difference, as they are logarithms.
    """
    if isinstance(expected, dict) and isinstance(observed, dict):
        keys = {k for k in (*expected, *observed) if k not in ignore}
        return [d for k in sorted(keys) for d in ([f"{path}/{k}: only in one"] if (k in expected) != (k in observed) else compare(expected[k], observed[k], tolerance, f"{path}/{k}", ignore))]
    if isinstance(expected, (list, tuple)) and isinstance(observed, (list, tuple)):
        if len(expected) != len(observed):
            return [f"{path}: {len(expected)} and {len(observed)} entries"]
        return [d for i, (a, b) in enumerate(zip(expected, observed)) for d in compare(a, b, tolerance, f"{path}/{i}", ignore)]
    numbers = [isinstance(x, (int, float)) and not isinstance(x, bool) for x in (expected, observed)]
    if all(numbers):
        if not (math.isfinite(expected) and math.isfinite(observed)):
            return [f"{path}: not finite"]
        scale = 1.0 if path.rpartition("/")[2].startswith("log_p") else max(abs(expected), abs(observed))
        return [] if abs(expected - observed) <= tolerance * scale or expected == observed else [f"{path}: {expected} and {observed}"]
    return [] if expected == observed and type(expected) is type(observed) else [f"{path}: {expected!r} and {observed!r}"]


def require_same(expected, observed, tolerance: float = 0.0, ignore: frozenset[str] = frozenset()) -> None:
    found = compare(expected, observed, tolerance, ignore=ignore)
    if found:
        raise GateError("; ".join(found[:10]))


def require_all(checks: dict, name: str = "") -> None:
    """That there are checks (name -> whether it holds), and that all of them hold."""
    failed = sorted(str(k) for k, v in checks.items() if not v)
    if failed or not checks:
        raise GateError(f"{name}: {len(failed)} of {len(checks)} checks failed: {failed}" if checks else f"{name}: nothing is checked")


def compare_tail(name: str, expected: float, observed: float, tolerance: float = 1e-6) -> list[str]:
    """Difference between two tail probabilities, by their decimal logarithms, so that tiny ones differ as large ones do; two that
    are zero agree, and zero counts as the least number above it."""
    if not all(isinstance(x, (int, float)) and 0 <= x <= 1 for x in (expected, observed)):
        return [f"{name}: {expected!r} and {observed!r} are not both probabilities"]
    a, b = (math.log10(max(x, math.ulp(0.0))) for x in (expected, observed))
    return [] if abs(a - b) <= tolerance * max(1.0, abs(a), abs(b)) else [f"{name}: {expected!r} and {observed!r}"]


def require_complete(results: dict, expected: list[str]) -> None:
    missing, extra = [e for e in expected if e not in results], [r for r in results if r not in expected]
    if missing or extra:
        raise GateError(f"missing {missing}, unexpected {extra}")


def only_field(expected: dict, observed: dict, field: str, tolerance: float = 0.0) -> None:
    """That two results differ in nothing but one field, given by its path (a/b), and do differ there: what a rerun with one
    input corrected must show."""
    found = compare(expected, observed, tolerance)
    paths = [d.partition(":")[0].lstrip("/") for d in found]
    other = [p for p in paths if p != field and not p.startswith(f"{field}/")]
    if other or not paths:
        raise GateError(f"differences beyond {field}: {other[:10]}" if other else f"{field} does not differ")


#: Fields of a pooled result that its table gives, by the names that results are published under as well.
PUBLISHED = {"Q": "q", "I2": "i2", "pQ": "p_q", "delta_FE": "delta_fe"}
POOLED = ("k", "delta", "se", "ci_lo", "ci_hi", "z", "q", "df", "tau2", "i2")
TESTED = ("p", "p_q", "delta_fe")


def verify_patients(effects: DataFrame, expected: DataFrame | None = None, column: str = "patient_id") -> None:
    """That every effect has a patient of its own, neither null nor empty, and that these are the expected ones, if given."""
    ids = effects.select(F.col(column).cast("string").alias("id"))
    counts = ids.groupBy("id").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_patients"), F.count_if((F.col("n") > 1) | F.col("id").isNull() | (F.col("id") == "")).alias("n_bad_patients"))
    if enforce(counts, "patients")["n_patients"] == 0:
        raise GateError("patients: the table has none")
    if expected is not None:
        enforce(same_sets(ids, expected.select(F.col(column).cast("string").alias("id")), "id"), "patients")


def verify_pooled(effects: DataFrame, claimed: dict, tolerance: float = 1e-8, expected: DataFrame | None = None, whole: bool = False) -> None:
    """That a published pooled result (k, delta, se, ci_lo, ci_hi, z, q, df, tau2, i2, and p, p_q, delta_fe) is what its table of
    effects (delta, se[, patient_id]) gives, field by field.

    A field of POOLED that the claim leaves out is an error, as is a number that is off; with whole, so is one of TESTED, which
    otherwise are compared where the claim has them. Tail probabilities are compared by logarithms. Patients, where the table
    names them, must be distinct, and those of expected (patient_id) if that is given. Other fields of the claim say nothing.
    """
    from .meta import check_effects, dersimonian_laird, with_tails

    if expected is not None or "patient_id" in effects.columns:
        verify_patients(effects, expected)
    made = with_tails(dersimonian_laird(check_effects(effects))).first()
    if made is None:
        raise GateError("the table has no effects")
    own = {PUBLISHED.get(f, f): v for f, v in claimed.items()}
    missing = [f for f in (*POOLED, *(TESTED if whole else ())) if f not in own]
    if missing:
        raise GateError(f"the claim has no {missing}")
    shown = [*POOLED, *(["delta_fe"] if "delta_fe" in own else [])]
    found = compare({f: made[f] for f in shown}, {f: own[f] for f in shown}, tolerance)
    for f in ("p", "p_q"):
        if f in own and (made[f] is None or own[f] is None):
            found += [] if made[f] is own[f] else [f"{f}: {made[f]!r} and {own[f]!r}"]
        elif f in own:
            found += compare_tail(f, made[f], own[f])
    if found:
        raise GateError("; ".join(found[:10]))

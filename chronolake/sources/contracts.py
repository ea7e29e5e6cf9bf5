"""Driver-side contracts: experiment settings as a table of rules, and files held to the digests of a manifest."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from numbers import Real

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MISSING = object()

# fixed values
QUALITIES = ("exact", "heuristic", "unknown")
FORMAL = "fomc_formal_experiment"


def _number(low: float | None = None, strict: bool = False, high: float | None = None, whole: bool = False) -> Callable:
    def ok(v) -> bool:
        if isinstance(v, bool) or not isinstance(v, int if whole else Real):
            return False
        above = low is None or (v > low if strict else v >= low)
        return above and (high is None or v < high)

    return ok


def _text(v) -> bool:
    return isinstance(v, str) and v.strip() != ""


def _is(x) -> Callable:
    return lambda v: v == x and type(v) is type(x)


#: path: (test, what it must be)
RULES: dict[str, tuple[Callable, str]] = {
    "experiment_name": (_text, "a text"),
    "random_seed": (_number(whole=True), "an integer"),
    "time.source_timezone": (_text, "a text"),
    "time.internal_timezone": (_text, "a text"),
    "probe.cv": (_is("timeseries"), "timeseries"),
    "probe.n_splits": (_number(2, whole=True), "an integer from 2"),
    "probe.n_permutations": (_number(0, strict=True, whole=True), "a positive integer"),
    "probe.alpha": (_number(0, strict=True), "positive"),
    "bootstrap.method": (_is("stationary"), "stationary"),
    "bootstrap.expected_block_length": (_number(0, strict=True), "positive"),
    "bootstrap.n_bootstrap": (_number(0, strict=True, whole=True), "a positive integer"),
    "bootstrap.confidence_level": (_number(0, strict=True, high=1), "between 0 and 1"),
    "economics.primary_metric": (_is("delta_ic"), "delta_ic"),
    "economics.threshold": (_number(0), "0 or more"),
    "economics.transaction_cost_bps": (_number(0), "0 or more"),
    "economics.annualization_factor": (_number(0, strict=True), "positive"),
    "pit.allowed_availability_qualities": (lambda v: isinstance(v, list) and v != [] and all(q in QUALITIES for q in v), f"a list of {', '.join(QUALITIES)}"),
}
FORMAL_RULES: dict[str, tuple[Callable, str]] = {
    "time.internal_timezone": (_is("UTC"), "UTC"),
    "probe.n_permutations": (_number(500), "500 or more"),
    "bootstrap.n_bootstrap": (_number(1000), "1000 or more"),
    "pit.allow_heuristic_fallback": (_is(False), "false"),
    "pit.allowed_availability_qualities": (_is(["exact"]), "exact alone"),
    "pit.require_timezone_aware": (bool, "true"),
    "pit.reject_missing_availability": (bool, "true"),
}
BOUNDARIES = ("train_end", "dev_start", "dev_end", "test_start")


def _at(settings: dict, path: str):
    for part in path.split("."):
        if not isinstance(settings, dict) or part not in settings:
            return _MISSING
        settings = settings[part]
    return settings


def _instant(text) -> dt.datetime:
    t = dt.datetime.fromisoformat(str(text))
    return t.astimezone(dt.UTC) if t.tzinfo else t.replace(tzinfo=dt.UTC)


def violations(settings: dict) -> list[str]:
    """All that is wrong with an experiment's settings, by path; empty if they hold."""
    out = []
    groups = [RULES] + ([FORMAL_RULES] if _at(settings, "experiment_name") == FORMAL else [])
    for rules in groups:
        for path, (test, what) in rules.items():
            v = _at(settings, path)
            if v is _MISSING or not test(v):
                out.append(f"{path}: {'missing' if v is _MISSING else f'{v!r} is not {what}'}")
    try:
        a, b, c, d = (_instant(_at(settings, f"splits.{k}")) for k in BOUNDARIES)
        if not a < b <= c < d:
            out.append("splits: not in order of time")
    except ValueError:
        out.append("splits: a boundary is missing or no ISO time")
    return out


def changed_files(spark: SparkSession, root: str, manifest: dict[str, str]) -> list[str]:
    """Names of a manifest whose file is absent or has another digest; files are read where Spark reads, also from a shared store."""
    from chronolake.sources.readers import digests

    have = {r.name: r.sha256 for r in digests(spark, root).where(F.col("name").isin(*manifest)).collect()}  # a file of the manifest a row
    return sorted(name for name, want in manifest.items() if have.get(name) != want.removeprefix("sha256:").lower())


def read_locked(spark: SparkSession, read: Callable[[str], DataFrame], root: str, name: str, manifest: dict[str, str]) -> DataFrame:
    """`read` of a file that the manifest names, or an error if it is another file than that."""
    if name not in manifest:
        raise ValueError(f"{name} isn't in the manifest")
    if changed_files(spark, root, {name: manifest[name]}):
        raise ValueError(f"{name} differs from its manifest")
    return read(f"{root}/{name}")


def differences(contract: dict, runtime: dict, prefix: str = "") -> list[str]:
    """Paths at which what was registered and what runs aren't equal, absent ones too."""
    out = []
    for key in sorted({*contract, *runtime}):
        a, b, path = contract.get(key, _MISSING), runtime.get(key, _MISSING), f"{prefix}{key}"
        if isinstance(a, dict) and isinstance(b, dict):
            out += differences(a, b, path + ".")
        elif a is _MISSING or b is _MISSING or a != b or type(a) is not type(b):
            out.append(path)
    return out


# What an authorization to run must name.
BINDINGS = ("protocol_sha256", "config_sha256", "source_tree_sha256", "seeds", "doses", "authorized_by", "authorized_at")


def unauthorized(authorization: dict | None, bound: dict) -> list[str]:
    """Why a run may not start: bindings that are missing, or that name something else than what would run."""
    if not authorization:
        return ["no authorization"]
    missing = [f"{k}: missing" for k in BINDINGS if authorization.get(k) in (None, "", [])]
    return missing + [f"{k}: not what runs" for k, v in bound.items() if authorization.get(k) not in (None, "", []) and authorization[k] != v]


def overlapping(modified: list[str], controlled: list[str]) -> list[str]:
    """Controlled files that have been modified."""
    return sorted({p.replace("\\", "/") for p in modified} & {p.replace("\\", "/") for p in controlled})


def findings(told: Column, registered: dict, bound: dict, controlled: list[str], paths: tuple[str, ...]) -> Column:
    """All that keeps runs from starting, as an array of (check, finding), from JSON of what each `runs`, is `bound` to, has `modified` and its `settings`.

    Of the settings only `paths` are looked at, and of these only values that aren't what they must be.
    """
    kind = pa.list_(pa.struct([("check", pa.string()), ("finding", pa.string())]))

    @F.arrow_udf("array<struct<check:string,finding:string>>")
    def ask(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            run = json.loads(t or "{}")
            bad = [v.split(":")[0] for v in violations(run.get("settings", {})) if "is not" in v]
            rows = {"contract": differences(registered, run.get("runs", {})), "authorization": unauthorized(run.get("bound"), bound), "controlled": overlapping(run.get("modified", []), controlled), "settings": [p for p in bad if p in paths]}
            out.append([{"check": k, "finding": f} for k, found in rows.items() for f in found])
        return pa.array(out, kind)

    return ask(told)


def allowed(samples: DataFrame, settings: dict) -> DataFrame:
    """The samples, or an error if one has an availability that the settings don't allow."""
    ok = _at(settings, "pit.allowed_availability_qualities")
    bad = samples.where(~F.coalesce(F.col("availability_quality").isin(*ok), F.lit(False))).limit(1).collect()
    if bad:
        raise ValueError(f"availability {bad[0].availability_quality!r} isn't allowed")
    return samples

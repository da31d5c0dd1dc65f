"""Column expressions: per-run features, scores and small decisions. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import constants as K


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


# ---- run features ------------------------------------------------------------------------------
def sequence_key(tools: Column) -> Column:
    """The exact tool list as text, so that equal lists share one key."""
    return F.to_json(tools)


def parse_tools(text: Column) -> Column:
    """JSON text to a list of names; anything unreadable counts as no tools."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def bigrams(tools: Column) -> Column:
    """Neighbouring tool pairs as structs (head, tail)."""
    return F.when(
        F.size(tools) >= 2,
        F.zip_with(
            F.slice(tools, F.lit(1), F.size(tools) - 1),
            F.slice(tools, F.lit(2), F.size(tools) - 1),
            lambda a, b: F.struct(a.alias("head"), b.alias("tail")),
        ),
    ).otherwise(F.array().cast("array<struct<head:string,tail:string>>"))


def retry_count(names: Column) -> Column:
    """How often a name directly follows itself."""
    return F.size(F.filter(bigrams(names), lambda p: p["head"] == p["tail"]))


def text_hash(text: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 16)


def outcome(text: Column, is_error: Column) -> Column:
    """error, unknown (no text), escalated (any escalation word) or resolved."""
    words = "|".join(K.ESCALATION_WORDS)
    return (
        F.when(F.coalesce(is_error, F.lit(False)), "error")
        .when(F.coalesce(text, F.lit("")) == "", "unknown")
        .when(F.lower(text).rlike(words), "escalated")
        .otherwise("resolved")
    )


def verbosity_ratio(prompt: Column, completion: Column) -> Column:
    return F.when(prompt > 0, completion / prompt).otherwise(F.lit(0.0))


def run_cost(prompt_rate: float = 2.50, completion_rate: float = 10.00) -> Column:
    """Price of one run; rates are per million tokens, missing counts are free."""
    prompt = F.coalesce(F.col("prompt_tokens"), F.lit(0)) / F.lit(1e6) * F.lit(prompt_rate)
    completion = F.coalesce(F.col("completion_tokens"), F.lit(0)) / F.lit(1e6) * F.lit(completion_rate)
    return prompt + completion


def task_cluster(tools: Column, prompt: Column) -> Column:
    """First tool and the size class of the prompt, e.g. ``search:100-500``."""
    size = F.length(F.coalesce(prompt, F.lit("")))
    bucket = (
        F.when(size < 100, "0-100").when(size < 500, "100-500").when(size < 2000, "500-2000").otherwise("2000+")
    )
    first = F.when(F.size(tools) > 0, F.element_at(tools, 1))
    return F.concat(F.coalesce(first, F.lit("unknown")), F.lit(":"), bucket)


def behaviour_vector() -> dict[str, Column]:
    """Twelve numbers in 0..1 per run, for multivariate anomaly detection."""
    size = F.size("tools")
    diversity = F.when(size > 0, F.size(F.array_distinct("tools")) / size).otherwise(F.lit(0.0))
    capped = lambda name, top: F.least(F.lit(1.0), F.col(name) / F.lit(top))
    return {
        "decision_drift": diversity,
        "tool_sequence": capped("tool_call_count", 20.0),
        "tool_distribution": diversity,
        "latency": capped("latency_ms", 5000.0),
        "error_rate": capped("error_count", 10.0),
        "loop_depth": capped("loop_count", 20.0),
        "verbosity_ratio": clamp01(F.col("verbosity_ratio")),
        "retry_rate": capped("retry_count", 5.0),
        "output_length": capped("output_length", 10000.0),
        "time_to_first_tool": capped("time_to_first_tool_ms", 5000.0),
        "semantic_drift": F.lit(0.0),
        "tool_sequence_transitions": F.lit(0.0),
    }


def calibration_scores() -> dict[str, Column]:
    """Per-run scores used for calibration; null where a run says nothing about the dimension."""
    vector = behaviour_vector()
    has_tools = F.when(F.size("tools") > 0, F.lit(0.0))
    return {
        **vector,
        "decision_drift": has_tools,
        "tool_sequence": has_tools,
        "tool_distribution": has_tools,
        "latency": F.when(F.col("latency_ms") > 0, vector["latency"]),
        "verbosity_ratio": F.least(F.lit(1.0), F.col("verbosity_ratio")),
    }


def run_quality() -> Column:
    """Mean of version clarity, completeness, derivability and richness, four digits."""
    source = F.lower(F.coalesce(F.col("version_source"), F.lit("unknown")))
    clarity = F.when(source.isin("release", "tag"), 1.0).when(source == "env", 0.7).when(source == "epoch", 0.3).otherwise(0.0)
    filled = lambda name: F.trim(F.coalesce(F.col(name), F.lit(""))) != ""
    positive = lambda name: F.coalesce(F.col(name), F.lit(0)) > 0
    points = lambda test, worth: F.when(test, F.lit(worth)).otherwise(F.lit(0.0))
    complete = F.least(
        F.lit(1.0),
        points(filled("input"), 0.25)
        + points(filled("output"), 0.25)
        + points(positive("latency_ms"), 0.20)
        + points(positive("prompt_tokens") | positive("completion_tokens"), 0.15)
        + points(filled("session_id"), 0.15),
    )
    derivable = points(F.col("feature_schema_version") > 0, 1.0)
    cluster = F.lower(F.coalesce(F.col("semantic_cluster"), F.lit("unknown")))
    rich = F.least(
        F.lit(1.0),
        points(F.size("tools") >= 1, 0.4)
        + points(positive("tool_call_count"), 0.2)
        + points(~cluster.isin("unknown", "cluster_none"), 0.2)
        + points(positive("retry_count") | positive("loop_count"), 0.2),
    )
    return F.round(F.lit(0.25) * (clarity + complete + derivable + rich), 4)


def fixed(x: Column, digits: int) -> Column:
    """x rounded to the digits a printed number shows: half to even, judged on the exact binary value.

    Spark rounds the shortest decimal text of a double, so 1.15 (stored a little below) would count as
    a tie. Where the text looks like a tie, the sign of x * 2 * 10**digits - odd decides; multiplying
    in powers of two keeps every step exact.
    """
    bits = [b for b in (1024, 512, 256, 128, 64, 32, 16, 8, 4, 2) if (2 * 10**digits) & b]
    scaled = x * F.lit(float(10**digits))
    low = F.floor(scaled)
    residual = x * F.lit(float(bits[0])) - (2 * low + 1).cast("double")
    for b in bits[1:]:
        residual = residual + x * F.lit(float(b))
    near = F.abs(scaled - low - 0.5) < 1e-9
    down, up = low / F.lit(float(10**digits)), (low + 1) / F.lit(float(10**digits))
    plain = F.bround(x.cast("double"), digits)
    return F.when(near & (residual > 0), up).when(near & (residual < 0), down).otherwise(plain)


# ---- scores ------------------------------------------------------------------------------------
def anchored_sigmoid(x: Column, k: float, c: float) -> Column:
    """Sigmoid moved so that 0 maps to 0, clamped to 0..1."""
    import math

    at_zero = 1.0 / (1.0 + math.exp(k * c))
    raw = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-k) * (x - F.lit(c))))
    return F.when(x <= 0, F.lit(0.0)).otherwise(clamp01((raw - F.lit(at_zero)) / F.lit(1.0 - at_zero)))


def emd_signal(emd: Column) -> Column:
    """Earth mover's distance of two latency distributions as a signal in 0..1."""
    raw = F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(2.718281828), F.lit(-0.002) * (emd - F.lit(500.0))))
    return F.when(emd == 0.0, F.lit(0.0)).otherwise(clamp01(raw))


def severity(score: Column, n: Column) -> Column:
    """Severity name; small samples raise the cuts by up to a factor of two."""
    import math

    log50 = math.log(50)
    factor = (
        F.when(n >= 50, F.lit(1.0))
        .when(n <= 0, F.lit(2.0))
        .otherwise(F.lit(1.0) + (F.lit(log50) - F.ln(n.cast("double"))) / F.lit(log50))
    )
    return (
        F.when(score >= F.lit(0.50) * factor, "critical")
        .when(score >= F.lit(0.35) * factor, "significant")
        .when(score >= F.lit(0.20) * factor, "moderate")
        .when(score >= F.lit(0.10) * factor, "low")
        .otherwise("none")
    )


def severity_verdict(level: Column) -> Column:
    """The verdict implied by a severity."""
    return (
        F.when(level.isin("none", "low"), "SHIP")
        .when(level == "moderate", "MONITOR")
        .when(level == "significant", "REVIEW")
        .when(level == "critical", "BLOCK")
    )


def threshold_verdict(score: Column, decision: Column, cuts: dict[str, Column] | None = None) -> Column:
    """BLOCK / REVIEW / MONITOR / SHIP from the composite and the decision drift."""
    cuts = cuts or {name: F.lit(value) for name, value in K.COMPOSITE_CUTS.items()}
    return (
        F.when((score > cuts["BLOCK"]) | (decision > 0.40), "BLOCK")
        .when((score > cuts["REVIEW"]) | (decision > 0.25), "REVIEW")
        .when(score > cuts["MONITOR"], "MONITOR")
        .otherwise("SHIP")
    )


def tier(n: Column, needed: Column) -> Column:
    return F.when(n < K.TIER1_MIN, "TIER1").when(n < needed, "TIER2").otherwise("TIER3")


def seeded_index(parts: list[Column], n: Column) -> Column:
    """A reproducible draw in 0..n-1: the first 32 bits of an MD5 over the parts, modulo n."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n


def poisson_draws(u: Column) -> Column:
    """Poisson(1) from a uniform number in 0..2^32-1: how many of the distribution's steps it reaches."""
    total = F.lit(0)
    for cut in K.POISSON_CUTS:
        total = total + (u >= F.lit(cut)).cast("int")
    return total

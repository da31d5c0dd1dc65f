"""Single functions on small inputs."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import constants as K
from tidemark.operators import budget, calibrate, decide, resample, select, usecase
from tidemark.sources import runs as runs_io
from tidemark.sources import traces as T


def one(spark, column, **values):
    return spark.range(1).select(*[v.alias(k) for k, v in values.items()]).select(column.alias("x")).first().x if values else spark.range(1).select(column.alias("x")).first().x


def test_presets_sum_to_one():
    for weights in K.PRESETS.values():
        assert abs(sum(weights) - 1) < 1e-9
    assert len(K.DIMS) == 12 and set(K.PRESET_DIMS) == set(K.DIMS)


@pytest.mark.parametrize(
    "text,error,expected",
    [("", False, "unknown"), ("all fine", False, "resolved"), ("I will ESCALATE this", False, "escalated"), ("I can't handle it", False, "escalated"), ("x", True, "error")],
)
def test_outcome(spark, text, error, expected):
    assert one(spark, C.outcome(F.col("t"), F.col("e")), t=F.lit(text), e=F.lit(error)) == expected


def test_sigmoid_is_anchored(spark):
    for x in (0.0, 0.2, 1.0, 5.0):
        want = 0.0 if x <= 0 else max(0, min(1, (1 / (1 + math.exp(-4 * (x - 0.3))) - 1 / (1 + math.exp(1.2))) / (1 - 1 / (1 + math.exp(1.2)))))
        assert abs(one(spark, C.anchored_sigmoid(F.col("v"), 4.0, 0.3), v=F.lit(x)) - want) < 1e-12


def test_printed_rounding_is_that_of_the_binary_value(spark):
    for digits, values in {1: (1.15, 1.25, 0.05, 12.35, 99.95, 0.0), 2: (0.125, 1.005, 2.675, 0.115), 3: (0.0005, 1.0005, 0.1235), 0: (0.5, 1.5, 2.5, 7.0)}.items():
        for v in values:
            assert f"{one(spark, C.fixed(F.col('v'), digits), v=F.lit(v)):.{digits}f}" == f"{v:.{digits}f}", (v, digits)


def test_severity_cuts_rise_for_small_samples(spark):
    assert one(spark, C.severity(F.col("s"), F.col("n")), s=F.lit(0.5), n=F.lit(50)) == "critical"
    assert one(spark, C.severity(F.col("s"), F.col("n")), s=F.lit(0.5), n=F.lit(15)) == "significant"
    assert one(spark, C.severity(F.col("s"), F.col("n")), s=F.lit(0.05), n=F.lit(1000)) == "none"


@pytest.mark.parametrize(
    "score,decision,verdict", [(0.1, 0.0, "SHIP"), (0.2, 0.0, "MONITOR"), (0.3, 0.0, "REVIEW"), (0.5, 0.0, "BLOCK"), (0.0, 0.41, "BLOCK"), (0.0, 0.26, "REVIEW")]
)
def test_threshold_verdict(spark, score, decision, verdict):
    assert one(spark, C.threshold_verdict(F.col("s"), F.col("d")), s=F.lit(score), d=F.lit(decision)) == verdict


def test_bigrams_and_retries(spark):
    tools = F.array(*[F.lit(t) for t in "aabba"])
    assert one(spark, C.retry_count(F.col("t")), t=tools) == 2
    assert one(spark, F.size(C.bigrams(F.col("t"))), t=F.array(F.lit("a"))) == 0
    assert one(spark, F.size(C.parse_tools(F.col("t"))), t=F.lit("oops")) == 0


def test_tool_words(spark):
    tools = spark.createDataFrame([("s", "runCreditCheck"), ("s", "call-fraud_api"), ("s", "a_b")], "session_id string, tool string")
    words = {}
    for r in usecase.tool_words(tools).orderBy("tool", "position").collect():
        words.setdefault(r.tool, []).append(r.word)
    assert words == {"runCreditCheck": ["run credit check", "run", "credit", "check"], "call-fraud_api": ["call fraud api", "call", "fraud", "api"]}


def test_keyword_use_case(spark):
    keywords = spark.createDataFrame(
        [("FINANCIAL", "credit", 2), ("FINANCIAL", "fraud", 2), ("LEGAL", "credit", 2), ("LEGAL", "contract", 2)], "use_case string, keyword string, points int"
    )
    tools = spark.createDataFrame(
        [("a", "check_credit"), ("a", "detect_fraud"), ("b", "run_tool"), ("b", "execute_task"), ("c", "read_contract")], "session_id string, tool string"
    )
    got = {r.session_id: (r.use_case, r.confidence) for r in usecase.keyword_use_case(tools, keywords).collect()}
    assert got["a"] == ("FINANCIAL", 1.0)  # the shared keyword counts for its first owner only
    assert got["b"] == ("GENERAL", 0.0)  # generic words only
    assert got["c"] == ("GENERAL", 0.0)  # two points are not enough


def test_blend_conflict_and_floor(spark):
    kw = spark.createDataFrame([("a", "FINANCIAL", 0.8), ("b", "LEGAL", 0.2), ("c", "GENERAL", 0.0)], "session_id string, use_case string, confidence double")
    beh = spark.createDataFrame([("a", "CONTENT_GENERATION", 0.6), ("b", "LEGAL", 0.4), ("c", "GENERAL", 0.0)], "session_id string, use_case string, confidence double")
    blend = usecase.blend_use_case(kw, beh)
    got = {r.session_id: r for r in blend.collect()}
    assert got["a"].method == "conflict_resolved" and got["a"].use_case == "FINANCIAL" and abs(got["a"].general_share - 0.2) < 1e-9
    assert got["b"].method == "blended" and abs(got["b"].kw_share - 0.5 / 0.9) < 1e-9
    assert got["c"].method == "general_fallback"
    sums = usecase.blended_weights(blend).groupBy("session_id").agg(F.sum("weight").alias("w")).collect()
    assert all(abs(r.w - 1) < 1e-9 for r in sums)


def test_t_quantiles_match_printed_tables(spark):
    df = spark.createDataFrame([(1,), (2,), (5,), (10,), (30,), (120,), (5000,)], "df long")
    got = {(r.df, r.level): r.t for r in calibrate.t_quantiles(spark, df).collect()}
    probs = {"MONITOR": 0.9772, "REVIEW": 0.9987, "BLOCK": 0.99997}
    for level, p in probs.items():
        assert abs(got[(1, level)] - math.tan(math.pi * (p - 0.5))) / got[(1, level)] < 1e-6  # Cauchy
        x = 2 * p - 1
        assert abs(got[(2, level)] - x * math.sqrt(2 / (1 - x * x))) / got[(2, level)] < 1e-6  # closed form
    assert abs(got[(5000, "MONITOR")] - 1.9991) < 2e-3
    assert got[(10, "BLOCK")] > got[(30, "BLOCK")] > got[(120, "BLOCK")]


def test_redistribute_without_anything_left(spark):
    weights = spark.createDataFrame([("s", "v", "e", "a", 1.0), ("s", "v", "e", "b", 0.0), ("s", "v", "e", "c", 0.0)], "session_id string, deployment_version string, environment string, dim string, weight double")
    gone = spark.createDataFrame([("a",)], "dim string")
    got = {r.dim: r.weight for r in calibrate.redistribute(weights, gone).collect()}
    assert got == {"a": 0.0, "b": 0.5, "c": 0.5}


def test_feedback_decay_has_a_floor(spark):
    weights = spark.createDataFrame([("s", "latency", 0.5), ("s", "error_rate", 0.5)], "session_id string, dim string, weight double")
    feedback = spark.createDataFrame([("s", "dismiss", ["latency"])] * 9 + [("s", "ack", ["error_rate"])], "session_id string, action string, dismissed_dimensions array<string>")
    got = {r.dim: r.adjusted for r in calibrate.feedback_decay(weights, feedback).collect()}
    assert abs(got["latency"] - 0.05) < 1e-12 and got["error_rate"] == 0.5


def test_limits_are_validated(spark):
    limits = spark.createDataFrame([("max_error_rate", "0.1"), ("max_error_rate", "lots"), ("max_magic", "1")], "budget_key string, limit_text string")
    assert sorted(r.problem for r in budget.validate_limits(limits).collect()) == ["not a number", "unknown key"]


def test_budget_needs_five_runs_and_is_strict(spark):
    rows = [("s", "v1", f"r{i}", datetime(2024, 1, 1, i), 100) for i in range(6)] + [("s", "v2", f"q{i}", datetime(2024, 1, 1, i), 900) for i in range(4)]
    runs = spark.createDataFrame(rows, "session_id string, deployment_version string, id string, started_at timestamp_ntz, latency_ms long")
    for c in ("error_count", "retry_count", "loop_count", "output_length", "time_to_first_tool_ms"):
        runs = runs.withColumn(c, F.lit(0).cast("long"))
    runs = runs.withColumn("semantic_cluster", F.lit("resolved")).withColumn("verbosity_ratio", F.lit(0.0))
    limits = spark.createDataFrame([("s", "v1", "max_p95_latency", 100.0), ("s", "v1", "min_resolution_rate", 1.1), ("s", "v2", "max_p95_latency", 1.0)], "session_id string, deployment_version string, budget_key string, limit_value double")
    got = budget.budget_breaches(budget.rolling_budget(runs), limits).collect()
    assert [(r.budget_key, r.direction, r.run_count) for r in got] == [("min_resolution_rate", "below", 6)]


@pytest.mark.parametrize("text", ["yesterday", "3d", "2024-01-01..2024-01-02"])
def test_time_filters_parse(spark, text):
    assert select.time_filter(text, datetime(2024, 2, 1)) is not None


def test_unknown_period_is_rejected(spark):
    with pytest.raises(ValueError):
        select.time_filter("soon", datetime(2024, 2, 1))


def test_tree_walk_orphans_and_cycles(spark):
    rows = [
        ("t", "1", None, 0, "span", "root"), ("t", "2", "1", 1, "span", "plan"), ("t", "3", "1", 2, "tool", "search"),
        ("t", "4", "2", 3, "generation", "llm-call"), ("t", "5", "2", 4, "tool", "write"), ("t", "6", "lost", 5, "tool", "orphan"),
        ("t", "7", "8", 6, "tool", "c1"), ("t", "8", "7", 7, "tool", "c2"),
    ]
    obs = spark.createDataFrame(rows, "trace_id string, id string, parent_id string, position long, type string, name string")
    tools = T.tree_tools(obs, 8).first().tree_tools
    assert [t for t in tools if not t.startswith("c")] == ["plan", "write", "search", "orphan"]
    assert sorted(t for t in tools if t.startswith("c")) == ["c1", "c2"]


def test_deep_chain_keeps_order(spark):
    rows = [("t", str(i), str(i - 1) if i else None, i, "tool", f"n{i:02d}") for i in range(30)]
    obs = spark.createDataFrame(rows, "trace_id string, id string, parent_id string, position long, type string, name string").repartition(5)
    assert T.tree_tools(obs).first().tree_tools == [f"n{i:02d}" for i in range(30)]


def counted_rounds(monkeypatch):
    """Names of the tables that are written: each round after the first table writes one of heads."""
    names, kept = [], T.kept
    monkeypatch.setattr(T, "kept", lambda df, name: (names.append(name), kept(df, name))[1])
    return names


def test_rounds_follow_the_depth_and_not_the_size(spark, monkeypatch):
    n = 100_000
    names = counted_rounds(monkeypatch)
    flat = spark.range(n).selectExpr(
        "'t' AS trace_id", "cast(id AS string) AS id", "if(id = 0, NULL, '0') AS parent_id", "id AS position", "'tool' AS type", "concat('n', id) AS name"
    )
    tools = T.tree_tools(flat.repartition(7)).first().tree_tools
    assert tools == [f"n{i}" for i in range(n)]
    assert names.count("heads") == 1


def test_long_chain_takes_a_logarithm_of_rounds(spark, monkeypatch):
    n = 5_000
    names = counted_rounds(monkeypatch)
    chain = spark.range(n).selectExpr(
        "'t' AS trace_id", "cast(id AS string) AS id", "cast(id - 1 AS string) AS parent_id", f"{n} - id AS position", "'tool' AS type", "concat('n', id) AS name"
    )
    tools = T.tree_tools(chain.repartition(7)).first().tree_tools
    assert tools == [f"n{i}" for i in range(n)]
    assert names.count("heads") == 13


def test_random_forests_equal_a_recursive_walk(spark):
    import random

    rng = random.Random(5)
    rows = []
    for t in range(6):
        ids = [f"{t}-{i}" for i in range(150)]
        for i, name in enumerate(ids):
            parent = rng.choice([None, "lost", name, *ids[max(0, i - 3) : i], *ids[max(0, i - 3) : i]])
            rows.append((f"t{t}", name, parent, rng.choice([None, i % 40, i]), "tool", name))
    obs = spark.createDataFrame(rows, "trace_id string, id string, parent_id string, position long, type string, name string").repartition(5)
    got = {r.trace_id: r.tree_tools for r in T.tree_tools(obs).collect()}
    for t in got:
        mine = sorted((r for r in rows if r[0] == t), key=lambda r: (-1 if r[3] is None else r[3], r[1]))
        known = {r[1] for r in mine}
        walked = []

        def walk(r):
            walked.append(r[1])
            for c in mine:
                if c[2] == r[1] and c[1] != r[1]:
                    walk(c)

        for r in mine:
            if r[2] not in known or r[2] == r[1]:
                walk(r)
        assert got[t] == walked


def test_children_of_a_repeated_id_come_once(spark):
    rows = [("t", "1", None, 0, "tool", "a"), ("t", "1", None, 3, "tool", "again"), ("t", "2", "1", 1, "tool", "child")]
    obs = spark.createDataFrame(rows, "trace_id string, id string, parent_id string, position long, type string, name string")
    assert T.tree_tools(obs).first().tree_tools == ["a", "child", "again"]


def test_tools_merge_in_order(spark):
    merged = one(spark, T.merge_tools(F.col("d"), F.col("t")), d=F.array(F.lit("a"), F.lit("a")), t=F.array(*[F.lit(x) for x in "bacb"]))
    assert merged == ["a", "a", "b", "c"]


def test_version_precedence(spark):
    row = {"release": None, "version": None, "meta_deployment_version": None, "meta_version": None, "meta_release": None}
    schema = "release string, version string, meta_deployment_version string, meta_version string, meta_release string, timestamp timestamp_ntz"

    def resolve(env=None, ts=datetime(2024, 1, 11), **given):
        df = spark.createDataFrame([tuple({**row, **given}.values()) + (ts,)], schema)
        return tuple(df.select(*T.version_columns(env)).first())

    assert resolve(release="r", version="t") == ("r", "release")
    assert resolve(version="t", meta_version="m") == ("t", "tag")
    assert resolve(meta_release="mr") == ("mr", "release")
    assert resolve(env="e") == ("e", "env")
    assert resolve() == ("epoch-2024-01-08", "epoch")
    assert resolve(ts=None) == ("unknown", "none")


def test_text_is_cut_only_at_the_limit(spark):
    raw = spark.createDataFrame([("a", "x" * 10, "y" * 11), ("b", "", None)], "id string, input string, output string")
    rows = {r.field: r for r in runs_io.store_text(raw, 10).collect()}
    assert not rows["input"].truncated and rows["output"].truncated
    assert rows["output"].content == "y" * 10 and rows["output"].content_length == 11
    assert len(runs_io.store_text(raw, 10).collect()) == 2


def test_export_round_trip(spark, tmp_path):
    import json

    path = tmp_path / "runs.json"
    path.write_text(json.dumps([{"id": "1", "session_id": "a", "started_at": "2024-01-02T03:04:05.678901+00:00", "completed_at": "2024-01-02T03:04:06Z", "tool_sequence": '["x", "y"]', "latency_ms": 5}]))
    row = runs_io.read_runs(spark, str(path)).first()
    assert row.started_at == datetime(2024, 1, 2, 3, 4, 5, 678901) and row.completed_at == datetime(2024, 1, 2, 3, 4, 6)
    assert row.tools == ["x", "y"] and row.deployment_version == "unknown" and row.error_count == 0


def test_root_cause_prefers_the_change_that_explains_most(spark):
    pairs = spark.createDataFrame([("s", "e", "v1", "v2")], "session_id string, environment string, baseline_version string, current_version string")
    changes = spark.createDataFrame(
        [("s", "v1", "rag_snapshot", "a"), ("s", "v2", "rag_snapshot", "b"), ("s", "v2", "tool_version", "2"), ("s", "v1", "prompt_hash", "p"), ("s", "v2", "prompt_hash", "p")],
        "session_id string, deployment_version string, change_type string, current_value string",
    )
    dims = spark.createDataFrame([("s", "e", "v1", "v2", d, 0.5) for d in ("latency", "error_rate", "tool_sequence")] + [("s", "e", "v1", "v2", "retry_rate", 0.1)], "session_id string, environment string, baseline_version string, current_version string, dim string, score double")
    row = decide.root_cause(dims, changes, pairs).first()
    assert (row.winner, row.confidence, row.previous, row.current, row.ruled_out) == ("tool_version", "HIGH", None, "2", "prompt_hash")


def test_time_offsets_become_utc(spark, tmp_path):
    times = ["2026-01-01T03:04:05+02:00", "2026-01-01T03:04:05Z", "2026-01-01 03:04:05", "2026-01-01T03:04:05.250-0330", "soon"]
    (tmp_path / "runs.json").write_text("\n".join(f'{{"id": "{k}", "started_at": "{t}"}}' for k, t in enumerate(times)))
    got = {r.id: str(r.started_at) for r in runs_io.read_runs(spark, str(tmp_path), multiline=False).collect()}
    assert got == {"0": "2026-01-01 01:04:05", "1": "2026-01-01 03:04:05", "2": "2026-01-01 03:04:05", "3": "2026-01-01 06:34:05.250000", "4": "None"}


def test_deep_chain_keeps_its_order(spark):
    from tidemark.sources import traces

    rows = [("t", f"n{k}", f"n{k - 1}" if k else None, 80 - k) for k in range(80)]
    paths = traces.tree_paths(spark.createDataFrame(rows, "trace_id string, id string, parent_id string, position int"))
    assert [r.id for r in paths.orderBy("path").collect()] == [f"n{k}" for k in range(80)]


def test_learned_weights_of_two_environments(spark):
    weights = spark.createDataFrame([("a", "v", e, d, 0.5) for e in ("prod", "dev") for d in ("x", "y")], "session_id string, deployment_version string, environment string, dim string, weight double")
    learned = spark.createDataFrame([("a", e, d, w, 1.0, 20) for e in ("prod", "dev") for d, w in (("x", 0.7), ("y", 0.3))], "session_id string, environment string, dim string, learned_weight double, learned_factor double, n_total long")
    from tidemark.operators import calibrate

    got = calibrate.learned_blend(weights, learned).collect()
    assert sorted((r.environment, r.dim, round(r.weight, 6)) for r in got) == [("dev", "x", 0.7), ("dev", "y", 0.3), ("prod", "x", 0.7), ("prod", "y", 0.3)]


def test_quantiles_have_their_own_value_at_any_size(spark):
    from statistics import NormalDist

    needed = spark.createDataFrame([(999,), (1000,), (10**6,), (10**9,)], "df long")
    got = {(r.df, r.level): r.t for r in calibrate.t_quantiles(spark, needed).collect()}
    for level, p in K.THRESHOLD_PROBS.items():
        series = spark.range(1).select(calibrate.expanded_quantile(F.lit(999), p).alias("t")).first().t
        assert abs(series - got[(999, level)]) < 1e-9
        z = NormalDist().inv_cdf(p)
        assert got[(1000, level)] > got[(10**6, level)] > got[(10**9, level)] > z
        assert got[(10**6, level)] - z < 1e-4


def test_difference_of_means_takes_all_runs(spark):
    runs = spark.range(1200).select(
        F.concat(F.lit("r"), F.col("id")).alias("id"), F.lit("s").alias("session_id"), F.lit("e").alias("environment"),
        F.when(F.col("id") < 600, "v1").otherwise("v2").alias("deployment_version"),
        (F.col("id") % 600 + F.when(F.col("id") < 600, 0).otherwise(50)).alias("latency_ms"),
    )
    pairs = spark.createDataFrame([("s", "e", "v1", "v2")], "session_id string, environment string, baseline_version string, current_version string")
    row = resample.bootstrap_mean_diff(runs, pairs).first()
    half = 1.96 * 173.2 * math.sqrt(2 / 600)
    assert abs(row.mean_diff - 50) < 1e-9
    assert abs((row.ci_upper - row.ci_lower) / (2 * half) - 1) < 0.15 and row.ci_lower < 50 < row.ci_upper


def test_root_cause_names_every_pair_with_advice(spark):
    pair = "session_id string, environment string, baseline_version string, current_version string"
    pairs = spark.createDataFrame([(s, "e", "v1", "v2") for s in ("none", "same", "model", "half", "own")], pair)
    rows = [("same", "v1", "prompt_hash", "p"), ("same", "v2", "prompt_hash", "p"), ("model", "v1", "model_version", "a"), ("model", "v2", "model_version", "b"),
            ("half", "v2", "model_version", "b"), ("own", "v1", "custom_flag", "0"), ("own", "v2", "custom_flag", "1")]
    changes = spark.createDataFrame(rows, "session_id string, deployment_version string, change_type string, current_value string")
    dims = spark.createDataFrame([(s, "e", "v1", "v2", "error_rate", 0.5) for s in ("none", "same", "model", "half", "own")], pair + ", dim string, score double")
    got = {r.session_id: r for r in decide.root_cause(dims, changes, pairs).collect()}
    assert len(got) == 5
    assert (got["none"].has_changes, got["none"].winner_score, got["none"].confidence) == (False, None, None)
    assert (got["same"].has_changes, got["same"].winner_score, got["same"].confidence, got["same"].ruled_out) == (True, 0.0, "UNLIKELY", "prompt_hash")
    assert 'model="a" vs model="b"' in got["model"].suggested_action and "Compare" not in got["half"].suggested_action
    assert "(custom_flag=1)" in got["own"].suggested_action and got["own"].confidence == "HIGH"


def test_last_good_version_of_each_environment(spark):
    rows = [("a", i, f"id{i}", "SHIP" if i == 0 else "BLOCK", "" if i == 0 else f"v{i}", "v0") for i in range(60)] + [("b", 5, "x", None, "w1", "w0")]
    history = spark.createDataFrame(rows, "environment string, recorded_at int, verdict_id string, verdict string, current_version string, baseline_version string")
    assert {tuple(r) for r in decide.last_good_version(history).collect()} == {("a", "v0"), ("b", "w1")}
    assert {tuple(r) for r in decide.last_good_version(history, window=20).collect()} == set()

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from pdwatch.operators import forest as T
from pdwatch.operators import impacts as I
from pdwatch.operators import reasons as R
from pdwatch.operators import records as N
from pdwatch.operators import registry as G
from pdwatch.operators import shap as S
from pdwatch.operators.quality import QualityError, check_impacts
from pdwatch.plans.explain import explain_batch
from pdwatch.sources.tables import read_partitioned

NAMES = ["a", "b", "c"]
FOREST = T.forest_of(
    -0.2,
    ("a", 1.0, ("b", 2.0, -0.5, ("a", 0.5, 0.4, 0.1)), ("c", 0.0, 0.8, ("a", 2.0, -0.3, 0.6))),
    ("b", 1.0, ("c", 1.0, 0.2, -0.7), 0.35),
)


def nested_margin(x):
    a, b, c = x
    first = (-0.5 if b <= 2 else (0.4 if a <= 0.5 else 0.1)) if a <= 1 else (0.8 if c <= 0 else (-0.3 if a <= 2 else 0.6))
    second = (0.2 if c <= 1 else -0.7) if b <= 1 else 0.35
    return -0.2 + first + second


def shapley(x, background):
    """By definition: every coalition, averaged over the background."""
    def worth(present):
        return np.mean([nested_margin([x[i] if i in present else z[i] for i in range(3)]) for z in background])

    phi = []
    for i in range(3):
        rest = [j for j in range(3) if j != i]
        phi.append(
            sum(
                factorial(k) * factorial(2 - k) / 6 * (worth(set(s) | {i}) - worth(set(s)))
                for k in range(3)
                for s in combinations(rest, k)
            )
        )
    return phi


@pytest.fixture(scope="module")
def population(spark):
    rng = np.random.default_rng(8)
    rows = [(f"x{i}", *map(float, v)) for i, v in enumerate(rng.normal(1, 1.2, (30, 3)))]
    background = [tuple(map(float, v)) for v in rng.normal(1, 1.5, (25, 3))]
    schema = "application_id string, a double, b double, c double"
    return (
        spark.createDataFrame(rows, schema),
        spark.createDataFrame(background, "a double, b double, c double"),
        rows,
        background,
    )


@pytest.mark.parametrize("batched", [False, True])
def test_impacts_equal_the_definition(population, batched, monkeypatch):
    if batched:
        monkeypatch.setattr(S, "EXPRESSION_LEAVES", 0)
    rows, background, raw, raw_background = population
    base = S.background_counts(background, FOREST)
    got = {r["application_id"]: r for r in S.shap_vectors(rows, FOREST, base, NAMES).withColumn("m", T.margin(FOREST)).collect()}
    mean = np.mean([nested_margin(z) for z in raw_background])
    assert base.expected_margin(FOREST) == pytest.approx(mean, abs=1e-12)
    for name, *x in raw:
        assert got[name]["m"] == pytest.approx(nested_margin(x), abs=1e-12)
        assert got[name]["impacts"] == pytest.approx(shapley(x, raw_background), abs=1e-12)
        assert sum(got[name]["impacts"]) == pytest.approx(nested_margin(x) - mean, abs=1e-12)


def _deep(features, rng):
    """One tree whose longest path holds every feature once."""
    node = float(rng.normal())
    for name in reversed(features):
        other = float(rng.normal())
        node = (name, float(rng.normal()), node, other) if rng.random() < 0.5 else (name, float(rng.normal()), other, node)
    return node


@pytest.mark.parametrize("depth", [9, 20, 40])
def test_deep_paths_add_up(spark, depth):
    rng = np.random.default_rng(depth)
    names = [f"f{n:02d}" for n in range(depth)]
    forest = T.forest_of(0.1, _deep(names, rng), _deep(names[::-1], rng), ("f00", 0.0, -1.0, 1.0))
    assert forest.depth == depth and (depth < 12 or not S._is_small(forest))
    schema = "application_id string, " + ", ".join(f"{n} double" for n in names)

    def table(rows):
        return spark.createDataFrame([(str(n), *map(float, rng.normal(0, 1, depth))) for n in range(rows)], schema)

    rows, base = table(200), S.background_counts(table(500), forest)
    vectors = S.shap_vectors(rows, forest, base, names, check_additivity=True, tolerance=1e-9)
    total = F.aggregate("impacts", F.lit(base.expected_margin(forest)), lambda a, v: a + v)
    assert vectors.select(F.max(F.abs(total - T.margin(forest)))).first()[0] < 1e-9


def test_expression_and_batch_agree_on_rows_with_gaps(population, spark, monkeypatch):
    rows, background, *_ = population
    dirty = rows.unionByName(
        spark.createDataFrame([("n", None, 1.0, 1.0), ("nan", 1.0, float("nan"), 1.0), ("inf", float("inf"), 0.0, -float("inf"))], rows.schema)
    )
    gaps = background.unionByName(spark.createDataFrame([(None, 1.0, 1.0), (1.0, float("nan"), 1.0)], background.schema))
    base = S.background_counts(gaps, FOREST)
    assert base.rows == background.count()
    found = {r["application_id"]: r["impacts"] for r in S.shap_vectors(dirty, FOREST, base, NAMES, check_additivity=True).collect()}
    monkeypatch.setattr(S, "EXPRESSION_SETS", 0)
    again = {r["application_id"]: r["impacts"] for r in S.shap_vectors(dirty, FOREST, base, NAMES, check_additivity=True).collect()}
    assert found["n"] is None and found["nan"] is None and again["n"] is None and again["nan"] is None
    for name in set(found) - {"n", "nan"}:
        assert found[name] == pytest.approx(again[name], abs=1e-12)


def test_impacts_that_do_not_add_up_are_refused(population):
    rows, background, *_ = population
    base = S.background_counts(background, FOREST)
    wrong = S.Background(base.rows, base.sets, (base.counts[0] * 2, *base.counts[1:]))
    with pytest.raises(Exception, match="do not add up"):
        S.shap_vectors(rows, T.Forest(5.0, FOREST.leaves), wrong, NAMES, check_additivity=True, tolerance=0.0).collect()


def test_background_must_have_rows(population):
    with pytest.raises(QualityError, match="empty"):
        S.background_counts(population[1].limit(0), FOREST)
    with pytest.raises(ValueError, match="not listed"):
        S.shap_vectors(population[0], FOREST, S.background_counts(population[1], FOREST), ["a", "b"])


@pytest.fixture(scope="module")
def two_entities(spark):
    names = ["feature_a", "feature_b", "feature_c"]
    df = spark.createDataFrame(
        [
            ("entity-1", "2026-07-30", 10.0, 4.0, 1.0, [0.40, -0.20, 0.10]),
            ("entity-2", "2026-07-31", 20.0, 8.0, 3.0, [-0.50, 0.80, 0.30]),
        ],
        "entity_id string, observation_date string, feature_a double, feature_b double, feature_c double, impacts array<double>",
    )
    background = spark.createDataFrame(
        [(5.0, 2.0, 0.0), (15.0, 6.0, 2.0), (25.0, 10.0, 4.0)], "feature_a double, feature_b double, feature_c double"
    )
    return df, names, I.typical_values(background, names)


def test_impact_table(two_entities):
    df, names, typical = two_entities
    ids = ["entity_id", "observation_date"]
    table = I.feature_impacts(df, names, typical, ids)
    first = {r["attribute_name"][-1]: r for r in table.where("entity_id = 'entity-1'").collect()}
    assert {k: r["ranked_impact_positive"] for k, r in first.items()} == {"a": 0, "c": 1, "b": 2}
    assert {k: r["ranked_impact_negative"] for k, r in first.items()} == {"b": 0, "c": 1, "a": 2}
    assert {k: r["ranked_impact_absolute"] for k, r in first.items()} == {"a": 0, "b": 1, "c": 2}
    assert [first[k]["risk_vs_typical"] for k in "abc"] == ["more", "less", "more"]
    assert [first[k]["value_vs_typical"] for k in "abc"] == ["less", "less", "less"]
    assert table.agg(F.sum("attribute_impact")).first()[0] == pytest.approx(0.90)
    assert I.identifier_columns(table) == ids
    long = table.select(*ids, "attribute_name", "attribute_value", "attribute_impact")
    assert sorted(I.rank_impacts(long, names, typical, ids).collect()) == sorted(table.collect())
    assert {r["violations"] for r in check_impacts(table, ids, names).collect()} == {0}
    missing = check_impacts(table.where("attribute_name <> 'feature_a' or entity_id <> 'entity-1'"), ids, names)
    assert {r["rule"]: r["violations"] for r in missing.collect()}["feature_missing"] == 1


def test_equal_impacts_rank_in_feature_order(spark, two_entities):
    df, names, typical = two_entities
    equal = df.withColumn("impacts", F.array(F.lit(0.3), F.lit(0.3), F.lit(-0.3)))
    rows = {r["attribute_name"][-1]: r for r in I.feature_impacts(equal, names, typical, ["entity_id"]).collect()}
    assert [rows[k]["ranked_impact_positive"] for k in "abc"] == [0, 1, 2]
    assert [rows[k]["ranked_impact_absolute"] for k in "abc"] == [0, 1, 2]


@pytest.fixture(scope="module")
def reason_input(spark):
    names = ["a", "b", "c"]
    df = spark.createDataFrame(
        [("entity-1", 1.0, 1.0, 1.0, [0.80, 0.20, -0.60]), ("entity-2", 1.0, 1.0, 1.0, [-0.90, 0.40, 0.10])],
        "entity_id string, a double, b double, c double, impacts array<double>",
    )
    registry = G.registry_from(
        {
            "a": {"display_name": "A", "reason_code": "RA", "metadata": {"business_priority": 2}},
            "b": {"display_name": "B", "metadata": {"business_priority": "1"}},
            "c": {"compliance_review_required": True, "metadata": {"business_priority": 3}},
        }
    )
    wide = I.with_impact_entries(df, names, dict.fromkeys(names, 1.0))
    return wide, I.expand(wide, ["entity_id"], "contributions"), registry


@pytest.mark.parametrize(
    "options, expected",
    [
        (dict(top_n=1), {"entity-1": ["a"], "entity-2": ["b"]}),
        (dict(top_n="all"), {"entity-1": ["a", "b"], "entity-2": ["b", "c"]}),
        (dict(direction="favorable", top_n="all"), {"entity-1": ["c"], "entity-2": ["a"]}),
        (dict(direction="all", top_n=2), {"entity-1": ["a", "c"], "entity-2": ["a", "b"]}),
        (dict(minimum=0.30), {"entity-1": ["a"], "entity-2": ["b"]}),
        (dict(direction="all", minimum=0.60), {"entity-1": ["a", "c"], "entity-2": ["a"]}),
        (dict(ranking="business_priority"), {"entity-1": ["b", "a"], "entity-2": ["b", "c"]}),
        (dict(direction="all", ranking="absolute_impact"), {"entity-1": ["a", "c", "b"], "entity-2": ["a", "b", "c"]}),
        (dict(minimum=5.0), {}),
    ],
)
def test_reason_selection_in_both_forms(reason_input, options, expected):
    wide, long, registry = reason_input
    chosen = R.select_reasons(long, registry=registry, **options)
    in_row = I.expand(
        wide.withColumn("reasons", R.reasons_in_row(F.col("contributions"), registry, **options)), ["entity_id"], "reasons"
    )
    assert "reason_rank" in chosen.columns
    for frame in (chosen, in_row):
        got = {}
        for r in sorted(frame.collect(), key=lambda r: (r["entity_id"], r["reason_rank"])):
            got.setdefault(r["entity_id"], []).append(r["attribute_name"])
        assert got == expected
    assert sorted(chosen.select(*in_row.columns).collect()) == sorted(in_row.collect())


def test_zero_impacts_are_no_reasons(reason_input):
    wide, _, registry = reason_input
    zero = wide.select("entity_id", "a", "b", "c", F.array(*[F.lit(0.0)] * 3).alias("impacts"))
    table = I.feature_impacts(zero, ["a", "b", "c"], dict.fromkeys("abc", 1.0), ["entity_id"])
    assert R.select_reasons(table, "adverse").count() == 0 and R.select_reasons(table, "favorable").count() == 0
    assert R.select_reasons(table, "all").count() == 6


def test_registry(spark, reason_input):
    _, long, registry = reason_input
    row = G.enrich(long, {}).where("attribute_name = 'a'").first()
    assert (row["display_name"], row["reason_code"], row["compliance_review_required"]) == ("a", None, False)
    assert row["business_priority"] == 1_000_000
    assert G.enrich(long, registry).where("attribute_name = 'c'").first()["business_priority"] == 3
    assert list(G.DEFAULT_REGISTRY)[:2] == ["income", "fico"] and G.DEFAULT_REGISTRY["age"].compliance_review_required
    with pytest.raises(ValueError, match="already"):
        G.with_entry(registry, G.Entry("a", "again"))
    assert G.with_entry(registry, G.Entry("a", "again"), overwrite=True)["a"].display_name == "again"
    with pytest.raises(ValueError):
        G.with_entry(registry, G.Entry(" ", "x"))
    with pytest.raises(ValueError, match="integer"):
        G.registry_frame(spark, G.registry_from({"z": {"metadata": {"business_priority": "high"}}}))


@pytest.mark.parametrize(
    "options", [dict(direction="up"), dict(ranking="size"), dict(top_n=0), dict(minimum=-0.1)]
)
def test_reason_arguments(reason_input, options):
    with pytest.raises(ValueError):
        R.select_reasons(reason_input[1], **options)
    with pytest.raises(TypeError):
        R.select_reasons(reason_input[1], top_n=1.5)


def test_explanation_job(population, tmp_path):
    rows, background, raw, _ = population
    applications = rows.withColumn("ts", F.lit("2026-07-30 10:00:00").cast("timestamp"))
    registry = G.registry_from({"a": {"display_name": "Feature A", "compliance_review_required": True}})
    path = str(tmp_path / "explanations")
    records = explain_batch(
        applications, FOREST, background, "v1", 0.5, NAMES, registry, top_n=2, persistence="table", path=path,
        metadata={"channel": "web"},
    )
    got = {r["application_id"]: r for r in records.collect()}
    assert len(got) == len(raw)
    for name, *x in raw:
        r = got[name]
        p = 1 / (1 + np.exp(-nested_margin(x)))
        assert r["default_probability"] == pytest.approx(p) and r["decision"] == ("decline" if p >= 0.5 else "approve")
        adverse = sum(c["attribute_impact"] > 0 for c in r["all_feature_contributions"])
        assert r["total_adverse_factors"] == len(r["adverse_action_reasons"]) == min(2, adverse)
        assert len(r["all_feature_contributions"]) == 3 and r["requested_top_n"] == "2"
        flagged = [c["attribute_name"] for c in r["adverse_action_reasons"] if c["attribute_name"] == "a"]
        assert r["compliance_review_required"] == bool(flagged)
        assert [f["display_name"] for f in r["compliance_flags"]] == ["Feature A"] * len(flagged)
        assert r["additional_metadata"] == {"channel": "web"}
    stored = read_partitioned(rows.sparkSession, path)
    assert stored.count() == len(raw) and str(stored.first()["dt"]) == "2026-07-30"
    assert {r["prediction_id"] for r in stored.collect()} == {r["prediction_id"] for r in got.values()}
    with pytest.raises(ValueError, match="path"):
        explain_batch(applications, FOREST, background, "v1", 0.5, NAMES, registry, persistence="table")
    with pytest.raises(ValueError, match="persistence"):
        explain_batch(applications, FOREST, background, "v1", 0.5, NAMES, registry, persistence="file")


def test_nested_records_keep_applications_without_reasons(spark, reason_input):
    wide, long, registry = reason_input
    named = long.withColumnRenamed("entity_id", "application_id")
    scored = spark.createDataFrame([("entity-1", 0.5), ("entity-2", 0.2)], "application_id string, p double").withColumn(
        "ts", F.lit("2026-07-30").cast("timestamp")
    )
    chosen = R.select_reasons(named, registry=registry, minimum=0.5, ids=["application_id"])
    nested = N.explanation_records(N.nest(scored, chosen, named), "p", 0.5, "v1")
    got = {r["application_id"]: r for r in nested.collect()}
    assert got["entity-1"]["total_adverse_factors"] == 1 and got["entity-1"]["decision"] == "decline"
    assert got["entity-2"]["adverse_action_reasons"] == [] and got["entity-2"]["decision"] == "approve"
    assert got["entity-2"]["additional_metadata"] is None and len(got["entity-2"]["all_feature_contributions"]) == 3
    with pytest.raises(ValueError, match="threshold"):
        N.explanation_records(N.nest(scored, chosen, named), "p", 1.5, "v1")


def test_batches_use_tables_for_short_paths_and_sets_for_long_ones(spark, monkeypatch):
    tree = ("a", 0.0, ("b", 1.0, -0.4, 0.3), ("c", 2.0, ("d", 0.5, 0.1, 0.2), 0.7))
    ensemble = T.forest_of(0.25, tree)
    rng = np.random.default_rng(4)
    rows = [(n, *map(float, rng.normal(0.5, 1.5, 4))) for n in range(60)]
    df = spark.createDataFrame(rows, "application_id long, a double, b double, c double, d double")
    base = S.background_counts(df, ensemble)
    found = []
    for narrow in (S.NARROW, 0):
        monkeypatch.setattr(S, "NARROW", narrow)
        again = S.background_counts(df, ensemble)
        assert [sorted(zip(s.tolist(), c.tolist())) for s, c in zip(base.sets, base.counts)] == [
            sorted(zip(s.tolist(), c.tolist())) for s, c in zip(again.sets, again.counts)
        ]
        made = S._by_batch(df, ensemble, again, ["a", "b", "c", "d"], "impacts", None)
        found.append(np.array([r["impacts"] for r in made.orderBy("application_id").collect()]))
    by_expression = S._by_expression(df, ensemble, base, ["a", "b", "c", "d"], "impacts", None)
    expected = np.array([r["impacts"] for r in by_expression.orderBy("application_id").collect()])
    assert np.allclose(found[0], expected, atol=1e-12) and np.allclose(found[1], expected, atol=1e-12)


def test_impact_check_counts_by_identifier(spark):
    rows = [("1", "a", 1.0), ("1", "b", None), ("1", "b", 2.0), ("2", "a", 0.5), ("2", "z", 0.5), ("2", None, 0.5), ("2", None, 0.5)]
    long = spark.createDataFrame(rows, "id string, attribute_name string, attribute_impact double")
    table = long.withColumns({c: F.lit(1) for c in I.IMPACT_COLUMNS if c not in long.columns})
    checked = check_impacts(table, ["id"], ["a", "b"])
    found = {r["rule"]: r["violations"] for r in checked.collect()}
    # Two rows without a name are one feature, repeated once.
    assert found == {"not_empty": 0, "impact_not_null": 1, "feature_known": 1, "feature_repeated": 2, "feature_missing": 0}
    assert "attribute_name" not in checked._jdf.queryExecution().optimizedPlan().toString().split("Aggregate [id")[1].split("]")[0]


def test_margin_descends_trees_and_tries_leaves_alike(spark):
    tree = ("a", 0.0, ("b", 1.0, -0.4, 0.3), ("a", 2.0, ("b", 0.5, 0.1, 0.2), 0.7))
    nested = T.forest_of(0.25, tree, ("b", 0.5, 1.0, -1.0))
    leaves = T.Forest(nested.base, nested.leaves)
    values = [0.0, 0.5, 1.0, 2.0, -3.0, 9.0, float("inf"), float("-inf"), float("nan"), None]
    df = spark.createDataFrame([(a, b) for a in values for b in values], "a double, b double")
    rows = df.select(T.margin(nested).alias("one"), T.margin(leaves).alias("other")).collect()
    assert [r["one"] for r in rows] == [r["other"] for r in rows]
    assert "<= 2.0" in str(T.margin(nested)) and "> 2.0" not in str(T.margin(nested))


def test_reasons_are_described_after_the_shuffle(spark):
    rows = [("1", n, float(10 - k)) for k, n in enumerate(("income", "fico", "debt", "unregistered"))]
    long = spark.createDataFrame(rows, "application_id string, attribute_name string, attribute_impact double")
    table = I.rank_impacts(
        long.withColumn("attribute_value", F.lit(1.0)), [r[1] for r in rows], {r[1]: 0.0 for r in rows}
    )
    found = R.select_reasons(table, "adverse", top_n=3, registry=G.DEFAULT_REGISTRY, ids=["application_id"])
    assert found.columns[-2:] == ["business_priority", "reason_rank"]
    assert [r["display_name"] for r in found.orderBy("reason_rank").collect()][:2] == ["Income", "Credit score"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftOuter") < plan.index("Window [")

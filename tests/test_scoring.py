"""Split exactness, model training and store, AUC, attributions."""

import pytest
from pyspark.sql import functions as F

from riskflow import vocab
from riskflow.operators import claims as oc
from riskflow.operators import explain as ox
from riskflow.operators import features as of
from riskflow.operators import scoring as om
from riskflow.plans import views

from .conftest import SF_SMALL


def _train_table(spark):
    c = views.claims(spark, SF_SMALL)
    feats = of.features(oc.claim_entities(c, "train"), keep=["case_id"])
    return feats.join(oc.claim_targets(c), "case_id")


def test_split_is_exact_and_deterministic(spark):
    df = spark.range(0, 1237).withColumnRenamed("id", "k")
    a = om.train_test_split(df, "k", 0.8, 42)
    assert a.where("is_train").count() == int(1237 * 0.8)
    b = om.train_test_split(df, "k", 0.8, 42)
    assert sorted(r.k for r in a.where("is_train").collect()) == sorted(r.k for r in b.where("is_train").collect())


def test_gbt_fit_score_and_store(spark, tmp_dir):
    t = _train_table(spark)
    split = om.train_test_split(t, "case_id", 0.8, 42).cache()
    train, test = split.where("is_train"), split.where("not is_train")
    p = om.fit_probability(train, max_iter=3, max_depth=3)
    s = om.fit_severity(train, max_iter=3, max_depth=3)
    scored = om.model_scores(test, p, s, "case_id")
    out = om.score(scored).collect()
    assert out and all(0.0 <= r["risk_probability"] <= 1.0 and r["predicted_claim_amount"] >= 0 for r in out)
    om.save_models(p, s, f"{tmp_dir}/models")
    p2, s2 = om.load_models(f"{tmp_dir}/models")
    again = om.model_scores(test, p2, s2, "case_id")
    a = {r["case_id"]: r["raw_probability"] for r in scored.collect()}
    b = {r["case_id"]: r["raw_probability"] for r in again.collect()}
    assert a == b  # consistency: same model, same input, same score
    with pytest.raises(Exception):
        om.load_models(f"{tmp_dir}/nothing-here")


def test_auc_matches_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    s = views.scored(spark, SF_SMALL).select(
        F.col("raw_probability").alias("score"),
        F.col("incident_severity").isin("Major Damage", "Total Loss").cast("double").alias("label"),
    )
    ours = om.roc_auc(s).first()["auc"]
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", metricName="areaUnderROC",
                                       numBins=0).evaluate(s)
    assert ours == pytest.approx(ev, abs=1e-6)


def test_linear_attribution_is_additive(spark):
    from riskflow.plans.q_quality import LINEAR_BETA

    t = _train_table(spark).select("case_id", *vocab.FEATURE_NAMES)
    means = t.agg(*[F.avg(n).alias(n) for n in vocab.FEATURE_NAMES]).first().asDict()
    contrib = ox.explain_linear(t, "case_id", ox.LinearModel(LINEAR_BETA, means))
    sums = contrib.groupBy("case_id").agg(F.sum("shap_value").alias("s"))
    margin = sum(F.lit(LINEAR_BETA[n]) * (F.col(n) - F.lit(means[n])) for n in vocab.FEATURE_NAMES)
    check = t.select("case_id", margin.alias("m")).join(sums, "case_id")
    assert check.where(F.abs(F.col("m") - F.col("s")) > 1e-9).count() == 0


def test_top_factors_rule(spark):
    long = spark.createDataFrame(
        [(1, i, vocab.FEATURE_NAMES[i], v) for i, v in enumerate([0.5, -0.9, 0.0, 1e-7, 0.9, 0.3, 0.2])],
        "k int, feature_index int, feature string, shap_value double",
    )
    rows = ox.top_factors(ox.collect_values(long, "k", n=7), "k").orderBy("factor_pos").collect()
    assert [r["feature_index"] for r in rows] == [1, 4, 0, 5, 6]
    assert rows[0]["direction"] == "decreases_risk" and rows[1]["direction"] == "increases_risk"
    assert rows[0]["name"] == vocab.FEATURE_DISPLAY_NAMES[vocab.FEATURE_NAMES[1]]


def test_tree_attributions_add_up(spark, tmp_dir):
    from pyspark.ml.functions import vector_to_array

    from riskflow.operators.tree_explain import explain_trees

    t = _train_table(spark).cache()
    model = om.fit_probability(t, max_iter=4, max_depth=3)
    gbt = model.stages[-1]
    phi = explain_trees(t, gbt, "case_id", f"{tmp_dir}/gbt")
    sums = phi.groupBy("case_id").agg((F.sum("shap_value") + F.first("base")).alias("s"))
    margin = model.transform(t).select("case_id", (2 * F.get(vector_to_array("rawPrediction"), 1)).alias("m"))
    check = sums.join(margin, "case_id")
    assert check.count() == t.count()
    assert check.where(F.abs(F.col("s") - F.col("m")) > 1e-9).count() == 0
    # the regressor margin is the prediction itself
    reg = om.fit_severity(t, max_iter=3, max_depth=3)
    phi2 = explain_trees(t, reg.stages[-1], "case_id", f"{tmp_dir}/gbr")
    s2 = phi2.groupBy("case_id").agg((F.sum("shap_value") + F.first("base")).alias("s"))
    p2 = reg.transform(t).select("case_id", F.col("prediction").alias("m"))
    assert s2.join(p2, "case_id").where(F.abs(F.col("s") - F.col("m")) > 1e-6).count() == 0


def test_tree_attributions_match_brute_force():
    """Shapley values of the path-dependent game by enumeration on one tree."""
    import itertools
    import math

    import numpy as np

    from riskflow.operators.tree_explain import _follows, _leaves

    # depth-2 tree on features 0 and 1 with covers
    nodes = {
        0: {"id": 0, "prediction": 0.0, "rawCount": 10, "leftChild": 1, "rightChild": 2,
            "split": {"featureIndex": 0, "leftCategoriesOrThreshold": [0.5], "numCategories": -1}},
        1: {"id": 1, "prediction": 0.0, "rawCount": 6, "leftChild": 3, "rightChild": 4,
            "split": {"featureIndex": 1, "leftCategoriesOrThreshold": [1.5], "numCategories": -1}},
        2: {"id": 2, "prediction": 3.0, "rawCount": 4, "leftChild": -1, "rightChild": -1, "split": None},
        3: {"id": 3, "prediction": 1.0, "rawCount": 2, "leftChild": -1, "rightChild": -1, "split": None},
        4: {"id": 4, "prediction": -2.0, "rawCount": 4, "leftChild": -1, "rightChild": -1, "split": None},
    }
    leaves = _leaves(nodes, 1.0, 1.0)
    x = np.array([[0.2, 2.0]])

    # direct enumeration of E[f | x_S] with the cover-weighted tree walk
    def walk(nid, S):
        n = nodes[nid]
        if n["leftChild"] < 0:
            return n["prediction"]
        f = n["split"]["featureIndex"]
        thr = n["split"]["leftCategoriesOrThreshold"][0]
        if f in S:
            return walk(n["leftChild"] if x[0, f] <= thr else n["rightChild"], S)
        l, r = nodes[n["leftChild"]], nodes[n["rightChild"]]
        return (l["rawCount"] * walk(n["leftChild"], S) + r["rawCount"] * walk(n["rightChild"], S)) / n["rawCount"]

    feats = [0, 1]
    phi_bf = {}
    for f in feats:
        others = [g for g in feats if g != f]
        tot = 0.0
        for k in range(len(others) + 1):
            for S in itertools.combinations(others, k):
                w = math.factorial(k) * math.factorial(len(feats) - k - 1) / math.factorial(len(feats))
                tot += w * (walk(0, set(S) | {f}) - walk(0, set(S)))
        phi_bf[f] = tot
    phi = np.zeros(2)
    for leaf in leaves:
        bits = 0
        for j in range(len(leaf.features)):
            bits |= int(_follows(x[:, leaf.features[j]], leaf.tests[j])[0]) << j
        phi[leaf.features] += leaf.table[bits]
    assert np.allclose(phi, [phi_bf[0], phi_bf[1]])
    assert math.isclose(sum(l.base for l in leaves) + phi.sum(), walk(0, {0, 1}))


def test_grouped_tree_tables_equal_leaf_by_leaf():
    """Leaves looked up together, by the splits they share, attribute what each
    leaf's own table does: repeated and categorical features, missing values, and
    paths of more splits than a group holds."""
    import numpy as np

    from riskflow.operators.tree_explain import GROUP_TESTS, _attributions, _follows, _groups, _leaves

    rng = np.random.default_rng(3)

    def tree(depth, features):
        nodes = {}

        def grow(level, count):
            at = len(nodes)
            nodes[at] = None
            children, split = (-1, -1), None
            if level < depth:
                f, left = int(rng.integers(features)), max(1, int(count * rng.uniform(0.2, 0.8)))
                children = grow(level + 1, left), grow(level + 1, max(1, count - left))
                split = {"featureIndex": f, "leftCategoriesOrThreshold": [0.0, 2.0] if f == 0 else [float(rng.integers(-9, 9)) / 4],
                         "numCategories": 4 if f == 0 else -1}
            nodes[at] = {"id": at, "prediction": float(rng.normal()), "rawCount": count, "leftChild": children[0],
                         "rightChild": children[1], "split": split}
            return at

        grow(0, 10**6)
        return _leaves(nodes, 0.5, 2.0)

    trees = [tree(6, 28), tree(6, 5), tree(0, 5), tree(GROUP_TESTS + 1, 28)]
    x = rng.normal(size=(28, 500))
    x[0] = rng.integers(0, 4, 500)
    x[3, ::7] = np.nan
    expected = np.zeros_like(x)
    for leaf in [leaf for leaves in trees for leaf in leaves]:
        bits = np.zeros(x.shape[1], np.int64)
        for j, f in enumerate(leaf.features):
            bits |= _follows(x[f], leaf.tests[j]).astype(np.int64) << j
        if len(leaf.features):
            expected[leaf.features] += leaf.table[bits].T
    groups = [_groups(leaves) for leaves in trees]
    assert np.allclose(_attributions(x, groups), expected, atol=1e-12)
    assert len(trees[0]) == 64 and len(groups[0]) <= 8  # one lookup for eight leaves, not one each


def test_nested_tree_attributions_equal_long(spark, tmp_dir):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    from riskflow.operators.tree_explain import explain_trees

    names = vocab.FEATURE_NAMES
    rows = spark.range(200).select(F.col("id").alias("k"), *[((F.col("id") * (i + 3)) % (i + 2)).cast("double").alias(n) for i, n in enumerate(names)])
    rows = rows.withColumn("y", (F.col("k") % 3 == 0).cast("double"))
    gbt = GBTClassifier(labelCol="y", maxIter=3, maxDepth=3, seed=1).fit(VectorAssembler(inputCols=names, outputCol="features").transform(rows))
    one = {r.k: r.shap_values for r in ox.collect_values(explain_trees(rows, gbt, "k", f"{tmp_dir}/a"), "k").collect()}
    nested = explain_trees(rows, gbt, "k", f"{tmp_dir}/b", nested=True)
    assert nested.columns == ["k", "shap_values", "base"]
    assert "Exchange" not in ox.collect_values(nested, "k")._jdf.queryExecution().executedPlan().toString()
    assert {r.k: r.shap_values for r in ox.collect_values(nested, "k").collect()} == one and len(one) == 200

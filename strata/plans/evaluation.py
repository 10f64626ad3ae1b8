"""Registered queries: evaluation, voting, rank tests.

Prediction tables come from ``labels`` joined to ``documents``: the true
class is the (quality, toxic) pair, predictions are rules on n_chars /
lang / source, and class scores are rational functions of n_chars (no
transcendental functions, so both engines produce bit-identical scores).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.recode import softmax_array  # noqa: F401  (re-exported for users)
from ..operators import evaluate as V
from ..operators import resample as RS
from ..operators import score as Q
from ..operators import stats as T
from .common import r6, table
from .prep import _split
from .registry import register

CLASSES = ["CN", "EMCI", "LMCI", "AD"]  # least to most severe

_PRED = """l.doc_id AS doc_id,
  CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'CN' WHEN l.quality = 1 THEN 'EMCI'
       WHEN l.toxic = 0 THEN 'LMCI' ELSE 'AD' END AS true_label,
  CASE WHEN d.n_chars < 3000 THEN 'AD' WHEN d.lang = 'en' THEN 'LMCI' WHEN d.n_chars < 30000 THEN 'CN'
       ELSE 'EMCI' END AS pred_a,
  CASE WHEN d.doc_id % 10 = 0 THEN NULL WHEN d.source IN ('src1', 'src2', 'src3') THEN 'EMCI'
       WHEN d.lang = 'en' THEN 'LMCI' ELSE 'CN' END AS pred_b,
  CASE WHEN d.n_chars < 10000 THEN 'LMCI' ELSE 'AD' END AS pred_c,
  CASE WHEN d.doc_id % 3 = 0 THEN 'CN' WHEN d.lang = 'en' THEN 'LMCI' ELSE 'AD' END AS pred_d,
  d.n_chars / (d.n_chars + CAST(5000 AS DOUBLE)) AS s0, (d.doc_id % 7 + 1) / CAST(7 AS DOUBLE) AS s1,
  CASE WHEN d.lang = 'en' THEN CAST(0.6 AS DOUBLE) ELSE CAST(0.2 AS DOUBLE) END AS s2,
  CAST(2000 AS DOUBLE) / (d.n_chars + CAST(2000 AS DOUBLE)) AS s3"""

_PRED_SQL = f"""p0 AS (SELECT {_PRED} FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
p AS (SELECT *, [s0 / (s0 + s1 + s2 + s3), s1 / (s0 + s1 + s2 + s3), s2 / (s0 + s1 + s2 + s3),
                 s3 / (s0 + s1 + s2 + s3)] AS probs FROM p0)"""


def predictions(spark, sf):
    lab = table(spark, sf, "labels").alias("l")
    doc = table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source").alias("d")
    p = lab.join(doc, F.col("d.doc_id") == F.col("l.doc_id")).selectExpr(*_split(_PRED))
    s = F.array("s0", "s1", "s2", "s3")
    tot = F.aggregate(s, F.lit(0.0), lambda a, x: a + x)
    return p.withColumn("probs", F.transform(s, lambda x: x / tot))


@register("confusion_matrix", f"""
WITH {_PRED_SQL},
g AS (SELECT t.c AS true_label, q.c AS pred_a FROM (VALUES ('CN'), ('EMCI'), ('LMCI'), ('AD')) t(c),
      (VALUES ('CN'), ('EMCI'), ('LMCI'), ('AD')) q(c)),
c AS (SELECT true_label, pred_a, count(*) AS n FROM p GROUP BY 1, 2),
m AS (SELECT g.true_label, g.pred_a, COALESCE(c.n, 0) AS n FROM g LEFT JOIN c USING (true_label, pred_a))
SELECT true_label, pred_a, n, round(CASE WHEN sum(n) OVER (PARTITION BY true_label) > 0
       THEN n / sum(n) OVER (PARTITION BY true_label) ELSE 0 END, 6) AS frac FROM m
""")
def q_confusion_matrix(spark, sf):
    cm = V.confusion_matrix(predictions(spark, sf), "true_label", "pred_a", CLASSES)
    return cm.select("true_label", "pred_a", "n", r6("frac").alias("frac"))


_REPORT_SQL = """t AS (SELECT true_label AS class, count(*) AS support, sum(CASE WHEN true_label = pred_a THEN 1 ELSE 0 END) AS tp
      FROM p GROUP BY 1),
q AS (SELECT pred_a AS class, count(*) AS predicted FROM p GROUP BY 1),
r0 AS (SELECT COALESCE(t.class, q.class) AS class, COALESCE(support, 0) AS support, COALESCE(tp, 0) AS tp,
              COALESCE(predicted, 0) AS predicted FROM t FULL JOIN q ON t.class = q.class),
r1 AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
              CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM r0),
r AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
      FROM r1)"""


@register("per_class_report", f"""
WITH {_PRED_SQL}, {_REPORT_SQL}
SELECT class, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM r
""")
def q_per_class_report(spark, sf):
    r = V.per_class_report(predictions(spark, sf), "true_label", "pred_a")
    return r.select("class", "support", *[r6(c).alias(c) for c in ["precision", "recall", "f1"]])


_AUC_SQL = """long AS (SELECT true_label, unnest(probs) AS score, unnest(['CN', 'EMCI', 'LMCI', 'AD']) AS class FROM p),
rk AS (SELECT class, score, true_label = class AS pos,
              rank() OVER (PARTITION BY class ORDER BY score) + (count(*) OVER (PARTITION BY class, score) - 1) / 2.0 AS rnk
       FROM long),
auc AS (SELECT class, CASE WHEN sum(CASE WHEN pos THEN 1 ELSE 0 END) > 0 AND sum(CASE WHEN pos THEN 0 ELSE 1 END) > 0
          THEN (sum(CASE WHEN pos THEN rnk ELSE 0 END) - sum(CASE WHEN pos THEN 1 ELSE 0 END)
                * (sum(CASE WHEN pos THEN 1 ELSE 0 END) + 1) / 2.0)
               / (sum(CASE WHEN pos THEN 1 ELSE 0 END) * sum(CASE WHEN pos THEN 0 ELSE 1 END)) END AS auc
        FROM rk GROUP BY 1)"""


@register("metric_set", f"""
WITH {_PRED_SQL}, {_REPORT_SQL}, {_AUC_SQL}
SELECT round(avg(f1), 6) AS f1_macro, round(sum(tp) / sum(support), 6) AS accuracy,
       round(avg(CASE WHEN support > 0 THEN recall END), 6) AS balanced_accuracy,
       round(sum(precision * support) / sum(support), 6) AS precision_weighted,
       round(sum(recall * support) / sum(support), 6) AS recall_weighted,
       round(sum(f1 * support) / sum(support), 6) AS f1_weighted,
       (SELECT round(CASE WHEN count(auc) = count(*) THEN avg(auc) END, 6) FROM auc) AS roc_auc_macro
FROM r
""")
def q_metric_set(spark, sf):
    m = V.metric_set(predictions(spark, sf), "true_label", "pred_a", probs="probs", classes=CLASSES)
    return m.select(*[r6(c).alias(c) for c in m.columns])


@register("roc_auc_per_class", f"""
WITH {_PRED_SQL}, {_AUC_SQL}
SELECT class, round(auc, 6) AS auc FROM auc
""")
def q_roc_auc_per_class(spark, sf):
    a = V.class_auc(predictions(spark, sf), "true_label", "probs", CLASSES)
    return a.select("class", r6("auc").alias("auc"))


@register("roc_curve", f"""
WITH {_PRED_SQL},
long AS (SELECT true_label, unnest(probs) AS score, unnest(['CN', 'EMCI', 'LMCI', 'AD']) AS class FROM p),
g AS (SELECT class, score, count(*) AS n_all, sum(CASE WHEN true_label = class THEN 1 ELSE 0 END) AS n_pos
      FROM long GROUP BY 1, 2),
c AS (SELECT *, sum(n_pos) OVER (PARTITION BY class ORDER BY score DESC) AS tp,
             sum(n_all) OVER (PARTITION BY class ORDER BY score DESC) AS ge,
             sum(n_pos) OVER (PARTITION BY class) AS P, sum(n_all) OVER (PARTITION BY class) AS A FROM g)
SELECT class, round(score, 6) AS threshold, round(tp / P, 6) AS tpr,
       round(CASE WHEN A > P THEN (ge - tp) / (A - P) END, 6) AS fpr FROM c WHERE P > 0
UNION ALL
SELECT class, NULL, 0.0, CASE WHEN sum(n_all) > sum(n_pos) THEN 0.0 END FROM g GROUP BY 1
UNION ALL
SELECT class, NULL, 1.0, 1.0 FROM g GROUP BY 1 HAVING sum(n_pos) = 0
""")
def q_roc_curve(spark, sf):
    r = V.roc_curve(predictions(spark, sf), "true_label", "probs", CLASSES)
    return r.select("class", r6("threshold").alias("threshold"), r6("tpr").alias("tpr"), r6("fpr").alias("fpr"))


def _folds(spark, sf):
    p = predictions(spark, sf)
    return RS.repeated_stratified_kfold(p, "true_label", "doc_id", k=5, repeats=2, seed=42)


_FOLD_SQL = f"""{_PRED_SQL},
f AS (SELECT *, CAST((row_number() OVER (PARTITION BY true_label, r ORDER BY md5('42:' || r || ':' || doc_id)) - 1) % 5
                     AS INTEGER) AS fold
      FROM (SELECT *, unnest(range(2)) AS r FROM p))"""


@register("fold_scores", f"""
WITH {_FOLD_SQL},
t AS (SELECT r, fold, true_label AS class, count(*) AS support, sum(CASE WHEN true_label = pred_a THEN 1 ELSE 0 END) AS tp
      FROM f GROUP BY ALL),
q AS (SELECT r, fold, pred_a AS class, count(*) AS predicted FROM f GROUP BY ALL),
r0 AS (SELECT COALESCE(t.r, q.r) AS r, COALESCE(t.fold, q.fold) AS fold, COALESCE(support, 0) AS support,
              COALESCE(tp, 0) AS tp, COALESCE(predicted, 0) AS predicted
       FROM t FULL JOIN q ON t.r = q.r AND t.fold = q.fold AND t.class = q.class),
r1 AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS pr,
              CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rc FROM r0)
SELECT CAST(r AS BIGINT) AS repeat, fold, round(sum(tp) / sum(support), 6) AS accuracy,
       round(avg(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END), 6) AS f1_macro
FROM r1 GROUP BY r, fold
""")
def q_fold_scores(spark, sf):
    m = V.metric_set(_folds(spark, sf), "true_label", "pred_a", by=["repeat", "fold"])
    return m.select(F.col("repeat").cast("bigint").alias("repeat"), "fold", r6("accuracy").alias("accuracy"),
                    r6("f1_macro").alias("f1_macro"))


def _model_split_metrics(spark, sf):
    p = RS.stratified_holdout(predictions(spark, sf), "true_label", "doc_id", 0.2, 42)
    p = p.withColumn("split", F.when(F.col("split") == "test", F.lit("Test")).otherwise(F.lit("Train")))
    long = p.select("doc_id", "true_label", "split", "probs",
                    F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"pred_{m}").alias("pred"))
                                        for m in ["a", "b", "c", "d"]])).alias("mp")).select(
        "doc_id", "true_label", "split", "probs", "mp.model", "mp.pred")
    return V.metric_set(long.filter(F.col("pred").isNotNull()), "true_label", "pred", by=["model", "split"])


_SPLIT_SQL = f"""{_PRED_SQL},
cc AS (SELECT true_label AS cls, count(*) AS n FROM p GROUP BY 1),
tt AS (SELECT sum(n) AS total, CAST(ceil(0.2 * sum(n)) AS BIGINT) AS n_test FROM cc),
aa AS (SELECT cls, n * n_test / total AS exact, floor(n * n_test / total) AS base FROM cc, tt),
bb AS (SELECT *, row_number() OVER (ORDER BY exact - base DESC, cls) AS pos FROM aa),
alloc AS (SELECT cls, base + CASE WHEN pos <= (SELECT n_test FROM tt) - (SELECT sum(base) FROM aa) THEN 1 ELSE 0 END AS k
          FROM bb),
sp AS (SELECT p.*, CASE WHEN row_number() OVER (PARTITION BY true_label ORDER BY md5('42:' || doc_id)) <= k
                   THEN 'Test' ELSE 'Train' END AS split FROM p JOIN alloc ON alloc.cls = p.true_label),
lng AS (SELECT doc_id, true_label, split, m.model, CASE m.model WHEN 'a' THEN pred_a WHEN 'b' THEN pred_b
               WHEN 'c' THEN pred_c ELSE pred_d END AS pred
        FROM sp, (VALUES ('a'), ('b'), ('c'), ('d')) m(model)),
ok AS (SELECT * FROM lng WHERE pred IS NOT NULL),
t AS (SELECT model, split, true_label AS class, count(*) AS support,
             sum(CASE WHEN true_label = pred THEN 1 ELSE 0 END) AS tp FROM ok GROUP BY ALL),
q AS (SELECT model, split, pred AS class, count(*) AS predicted FROM ok GROUP BY ALL),
r0 AS (SELECT COALESCE(t.model, q.model) AS model, COALESCE(t.split, q.split) AS split, COALESCE(support, 0) AS support,
              COALESCE(tp, 0) AS tp, COALESCE(predicted, 0) AS predicted
       FROM t FULL JOIN q ON t.model = q.model AND t.split = q.split AND t.class = q.class),
r1 AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS pr,
              CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rc FROM r0),
ms AS (SELECT model, split, avg(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END) AS f1_macro,
              sum(tp) / sum(support) AS accuracy FROM r1 GROUP BY ALL)"""


@register("evaluate_splits", f"""
WITH {_SPLIT_SQL}
SELECT model, split, round(f1_macro, 6) AS f1_macro, round(accuracy, 6) AS accuracy FROM ms
""")
def q_evaluate_splits(spark, sf):
    m = _model_split_metrics(spark, sf)
    return m.select("model", "split", r6("f1_macro").alias("f1_macro"), r6("accuracy").alias("accuracy"))


@register("test_comparison", f"""
WITH {_SPLIT_SQL}
SELECT model, round(f1_macro, 6) AS f1_macro, round(accuracy, 6) AS accuracy FROM ms WHERE split = 'Test'
""")
def q_test_comparison(spark, sf):
    m = V.test_comparison(_model_split_metrics(spark, sf).filter(F.col("split") == "Test"))
    return m.select("model", r6("f1_macro").alias("f1_macro"), r6("accuracy").alias("accuracy"))


@register("f1_by_split", f"""
WITH {_SPLIT_SQL}
SELECT model, round(max(CASE WHEN split = 'Train' THEN f1_macro END), 6) AS "Train",
       round(max(CASE WHEN split = 'CrossVal' THEN f1_macro END), 6) AS "CrossVal",
       round(max(CASE WHEN split = 'Test' THEN f1_macro END), 6) AS "Test",
       round(COALESCE(max(CASE WHEN split = 'Test' THEN f1_macro END), max(CASE WHEN split = 'CrossVal' THEN f1_macro END),
                      max(CASE WHEN split = 'Train' THEN f1_macro END)), 6) AS order_key
FROM ms GROUP BY model
""")
def q_f1_by_split(spark, sf):
    f = V.f1_by_split(_model_split_metrics(spark, sf))
    return f.select("model", *[r6(c).alias(c) for c in ["Train", "CrossVal", "Test", "order_key"]])


@register("promote_best", f"""
WITH {_SPLIT_SQL}
SELECT 'best_test_f1' AS alias, arg_min(model, struct_pack(m := -f1_macro, n := model)) AS model FROM ms WHERE split = 'Test'
""")
def q_promote_best(spark, sf):
    return V.promote_best(_model_split_metrics(spark, sf).filter(F.col("split") == "Test"), "best_test_f1")


@register("class_list", f"""
WITH {_PRED_SQL}
SELECT DISTINCT label FROM (SELECT true_label AS label FROM p UNION ALL SELECT pred_b FROM p) WHERE label IS NOT NULL
""")
def q_class_list(spark, sf):
    p = predictions(spark, sf)
    return V.class_list((p, "true_label"), (p, "pred_b"))


@register("align_probabilities", f"""
WITH {_PRED_SQL},
a AS (SELECT doc_id, [s3, 0.000001, s0] AS v FROM p0)
SELECT doc_id, round(v[1] / (v[1] + v[2] + v[3]), 6) AS p_ad, round(v[2] / (v[1] + v[2] + v[3]), 6) AS p_lmci,
       round(v[3] / (v[1] + v[2] + v[3]), 6) AS p_cn FROM a
""")
def q_align_probabilities(spark, sf):
    p = predictions(spark, sf).withColumn("raw", F.array("s0", "s3"))  # a model that only knows CN and AD
    a = V.align_probabilities(p, "raw", ["CN", "AD"], ["AD", "LMCI", "CN"], out="aligned")
    return a.select("doc_id", r6(F.col("aligned")[0]).alias("p_ad"), r6(F.col("aligned")[1]).alias("p_lmci"),
                    r6(F.col("aligned")[2]).alias("p_cn"))


# ------------------------------------------------------------------ scoring Q2-Q5, I6

@register("top_probability", f"""
WITH {_PRED_SQL}
SELECT doc_id, round(list_max(probs), 6) AS top_p FROM p
""")
def q_top_probability(spark, sf):
    return predictions(spark, sf).select("doc_id", r6(Q.top_probability("probs")).alias("top_p"))


@register("severity_tie_break", f"""
WITH {_PRED_SQL},
b AS (SELECT doc_id, probs, list_max(probs) AS m FROM p)
SELECT doc_id, CASE WHEN probs[4] >= m - 1e-12 THEN 'AD' WHEN probs[3] >= m - 1e-12 THEN 'LMCI'
                    WHEN probs[2] >= m - 1e-12 THEN 'EMCI' WHEN probs[1] >= m - 1e-12 THEN 'CN' END AS label FROM b
""")
def q_severity_tie_break(spark, sf):
    p = predictions(spark, sf)
    return p.select("doc_id", Q.severity_tie_break("probs", CLASSES).alias("label"))


_VOTE_SQL = """v AS (SELECT doc_id, [pred_a, pred_b, pred_c, pred_d] AS a FROM p),
e AS (SELECT doc_id, a, unnest(a) AS x, unnest(range(4)) AS i FROM v),
c AS (SELECT e.doc_id, e.i, e.x, (SELECT count(*) FROM e e2 WHERE e2.doc_id = e.doc_id AND e2.x = e.x) AS cnt FROM e
      WHERE e.x IS NOT NULL),
b AS (SELECT doc_id, arg_min(x, struct_pack(c := -cnt, i := i)) AS best, max(cnt) AS mx,
             arg_min(x, i) AS first_nn FROM c GROUP BY 1),
vote AS (SELECT v.doc_id, CASE WHEN b.mx >= 2 THEN b.best ELSE b.first_nn END AS vote FROM v LEFT JOIN b USING (doc_id))"""


@register("majority_vote", f"""
WITH {_PRED_SQL}, {_VOTE_SQL}
SELECT doc_id, vote FROM vote
""")
def q_majority_vote(spark, sf):
    p = predictions(spark, sf)
    return p.select("doc_id", Q.majority_vote(F.array("pred_a", "pred_b", "pred_c", "pred_d")).alias("vote"))


@register("vote_report", f"""
WITH {_PRED_SQL}, {_VOTE_SQL},
w AS (SELECT p.*, vote.vote FROM p JOIN vote USING (doc_id)),
u AS (SELECT 'pred_a' AS model, pred_a AS label FROM w UNION ALL SELECT 'pred_b', pred_b FROM w UNION ALL
      SELECT 'pred_c', pred_c FROM w UNION ALL SELECT 'pred_d', pred_d FROM w UNION ALL SELECT 'vote', vote FROM w)
SELECT model, label, count(*) AS count FROM u GROUP BY ALL
""")
def q_vote_report(spark, sf):
    p = predictions(spark, sf)
    p = p.withColumn("vote", Q.majority_vote(F.array("pred_a", "pred_b", "pred_c", "pred_d")))
    return Q.vote_report(p, ["pred_a", "pred_b", "pred_c", "pred_d"], "vote")


@register("fill_label_by_vote", f"""
WITH {_PRED_SQL}, {_VOTE_SQL}
SELECT doc_id, COALESCE(CASE WHEN doc_id % 4 = 0 THEN NULL ELSE p.true_label END, vote.vote) AS label
FROM p JOIN vote USING (doc_id)
""")
def q_fill_label_by_vote(spark, sf):
    p = predictions(spark, sf)
    p = p.select("doc_id", F.expr("CASE WHEN doc_id % 4 = 0 THEN NULL ELSE true_label END").alias("label"),
                 Q.majority_vote(F.array("pred_a", "pred_b", "pred_c", "pred_d")).alias("vote"))
    return Q.fill_label_by_vote(p, "label", "vote").select("doc_id", "label")


# ------------------------------------------------------------------ statistics T1, T2, T4, T5

@register("kruskal_wallis", """
WITH u AS (SELECT event_type AS g, 'value' AS "column", value AS v FROM events UNION ALL
           SELECT event_type, 'user_id', CAST(user_id AS DOUBLE) FROM events),
r AS (SELECT *, rank() OVER (PARTITION BY "column" ORDER BY v) + (count(*) OVER (PARTITION BY "column", v) - 1) / 2.0 AS rk
      FROM u),
s AS (SELECT "column", g, sum(rk) AS R, count(*) AS ng FROM r GROUP BY ALL),
t AS (SELECT "column", sum(k * k * k - k) AS tie, sum(k) AS N FROM (SELECT "column", v, count(*) AS k FROM u GROUP BY ALL)
      GROUP BY 1),
h AS (SELECT s."column", (12.0 / (N * (N + 1)) * sum(R * R / ng) - 3 * (N + 1)) / (1 - tie / (N * N * N - N)) AS h,
             count(*) - 1 AS dof, any_value(N) AS n FROM s JOIN t USING ("column") GROUP BY s."column", N, tie)
SELECT "column", round(h, 6) AS h, dof, n, round(exp(-h / 2) * (1 + h / 2), 6) AS p_value FROM h
""")
def q_kruskal_wallis(spark, sf):
    ev = table(spark, sf, "events")
    k = T.kruskal_wallis(ev, ["value", "user_id"], "event_type")
    return k.select("column", r6("h").alias("h"), "dof", "n", r6("p_value").alias("p_value"))


def _daily(spark, sf):
    ev = table(spark, sf, "events")
    return ev.groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("model")).agg(F.sum("value").alias("score"))


@register("wilcoxon_pairwise", """
WITH s AS (SELECT CAST(ts AS DATE) AS day, event_type AS model, sum(value) AS score FROM events GROUP BY 1, 2),
d AS (SELECT a.model AS model_a, b.model AS model_b, a.score - b.score AS d
      FROM s a JOIN s b ON a.day = b.day AND a.model < b.model WHERE a.score - b.score <> 0),
r AS (SELECT *, rank() OVER (PARTITION BY model_a, model_b ORDER BY abs(d))
                + (count(*) OVER (PARTITION BY model_a, model_b, abs(d)) - 1) / 2.0 AS rk FROM d)
SELECT model_a, model_b, count(*) AS n, round(least(sum(CASE WHEN d > 0 THEN rk ELSE 0 END),
                                                     sum(CASE WHEN d < 0 THEN rk ELSE 0 END)), 6) AS statistic
FROM r GROUP BY 1, 2
""")
def q_wilcoxon_pairwise(spark, sf):
    w = T.wilcoxon_pairwise(_daily(spark, sf), "model", "day", "score", with_p=False)
    return w.select("model_a", "model_b", "n", r6("statistic").alias("statistic"))


@register("wilcoxon_pvalues")
def q_wilcoxon_pvalues(spark, sf):
    """Rows-only: exact / normal p-values are checked against hand-worked fixtures in tests."""
    w = T.wilcoxon_pairwise(_daily(spark, sf), "model", "day", "score", with_p=True)
    return w.select("model_a", "model_b", "n", r6("statistic").alias("statistic"), r6("p_value").alias("p_value"))


@register("linear_redundancy", """
WITH j AS (SELECT o.o_totalprice AS y, s.x FROM orders o JOIN (SELECT l_orderkey, sum(l_extendedprice) AS x FROM lineitem
           GROUP BY 1) s ON s.l_orderkey = o.o_orderkey),
c AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM j),
e AS (SELECT y, y - (a + b * x) AS err, a, b FROM j, c)
SELECT count(*) AS n, round(1 - avg(err * err) / var_pop(y), 6) AS r2, round(avg(err * err), 0) AS mse,
       round(sqrt(avg(err * err)), 4) AS rmse, round(max(abs(err)), 4) AS max_abs_error,
       round(avg(CASE WHEN abs(err) <= 1 THEN 1.0 ELSE 0.0 END) * 100, 4) AS pct_within_1,
       round(any_value(a), 4) AS intercept, round(any_value(b), 6) AS coef_x FROM e
""")
def q_linear_redundancy(spark, sf):
    o = table(spark, sf, "orders")
    s = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("x"))
    j = o.join(s, o.o_orderkey == s.l_orderkey).select(F.col("o_totalprice").alias("y"), "x")
    st, _ = T.linear_redundancy(j, "y", ["x"])

    def r4(c):
        return (F.round(F.col(c) * 1e4) / 1e4).alias(c)
    return st.select("n", r6("r2").alias("r2"), F.round(F.col("mse")).alias("mse"), r4("rmse"), r4("max_abs_error"), r4("pct_within_1"),
                     r4("intercept"), r6("coef_x").alias("coef_x"))


@register("composite_check", """
WITH t AS (SELECT CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_quantity END AS a, l_discount * 100 AS b, l_tax * 100 AS c,
                  l_quantity + l_discount * 100 + l_tax * 100 AS total FROM lineitem),
u AS (SELECT total, COALESCE(a, 0) + COALESCE(b, 0) + COALESCE(c, 0) AS s,
             (COALESCE(a, 0) + COALESCE(b, 0) + COALESCE(c, 0)) / ((CASE WHEN a IS NULL THEN 0 ELSE 1 END) + 2) AS m FROM t)
SELECT round(max(abs(total - s)), 6) AS max_abs_diff_sum, round(max(abs(total - m)), 6) AS max_abs_diff_mean,
       round(corr(total, s), 6) AS corr_sum, round(corr(total, m), 6) AS corr_mean FROM u
""")
def q_composite_check(spark, sf):
    li = table(spark, sf, "lineitem").selectExpr(
        "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_quantity END AS a", "l_discount * 100 AS b", "l_tax * 100 AS c",
        "l_quantity + l_discount * 100 + l_tax * 100 AS total")
    c = T.composite_check(li, "total", ["a", "b", "c"])
    return c.select(*[r6(x).alias(x) for x in c.columns])


@register("mutual_information", f"""
WITH {_PRED_SQL},
d AS (SELECT 'n_chars' AS feature, p.doc_id AS k, true_label AS y, CAST(n_chars AS DOUBLE) AS x FROM p JOIN documents t ON t.doc_id = p.doc_id
      UNION ALL SELECT 'src', p.doc_id, true_label, CAST(substr(source, 4) AS DOUBLE) FROM p JOIN documents t ON t.doc_id = p.doc_id),
f AS (SELECT * FROM d WHERE x IS NOT NULL AND y IS NOT NULL),
e AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY feature, y) AS nc FROM f) WHERE nc > 1),
nn AS (SELECT a.feature, a.k, a.x, a.nc, abs(a.x - b.x) AS r, row_number() OVER (PARTITION BY a.feature, a.k ORDER BY abs(a.x - b.x), b.k) AS rk
       FROM e a JOIN e b ON a.feature = b.feature AND a.y = b.y AND a.k <> b.k),
kth AS (SELECT *, least(3, nc - 1) AS kk FROM nn WHERE rk = least(3, nc - 1)),
m AS (SELECT a.feature, a.k, any_value(a.kk) AS kk, any_value(a.nc) AS nc,
             sum(CASE WHEN CASE WHEN a.r > 0 THEN abs(a.x - b.x) < a.r ELSE a.x = b.x END THEN 1 ELSE 0 END) AS m
      FROM kth a JOIN e b ON a.feature = b.feature GROUP BY 1, 2),
psi AS (SELECT i, COALESCE(sum(CAST(1 AS DOUBLE) / i) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 0.5772156649015329 AS v
        FROM (SELECT unnest(range(1, (SELECT count(*) FROM documents) + 2)) AS i)),
s AS (SELECT feature, count(*) AS n, avg(pk.v) - avg(pc.v) - avg(pm.v) AS rest
      FROM m JOIN psi pk ON pk.i = kk JOIN psi pc ON pc.i = nc JOIN psi pm ON pm.i = m.m GROUP BY 1)
SELECT feature, n, round(greatest(0, psi.v + rest), 6) AS mi FROM s JOIN psi ON psi.i = n
""")
def q_mutual_information(spark, sf):
    """K-NN mutual information (k=3) of document length and of the
    source id with the quality x toxic class; the oracle compares all pairs."""
    p = predictions(spark, sf)
    doc = table(spark, sf, "documents").select("doc_id", "n_chars", F.expr("CAST(substr(source, 4) AS DOUBLE)").alias("src"))
    d = p.select("doc_id", "true_label").join(doc, "doc_id")
    return (T.mutual_information(d, "doc_id", "n_chars", "true_label")
            .unionByName(T.mutual_information(d, "doc_id", "src", "true_label"))
            .select("feature", "n", r6("mi").alias("mi")))

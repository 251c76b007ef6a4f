"""Scores, metrics, agreement and paired statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import scoring as SC
from quern.operators import statistics as ST
from quern.plans.registry import Query
from quern.session import table as t

QUERIES: list[Query] = []


def q(name, sql=None):
    def add(f):
        QUERIES.append(Query(name, f, sql))
        return f

    return add


SCORED = "s AS (SELECT doc_id, quality AS y, (n_chars % 97)::DOUBLE AS score, CASE WHEN n_chars % 3 = 0 THEN 0 ELSE 1 END AS yhat, lang, n_chars FROM documents JOIN labels USING (doc_id))"


def scored(s, d):
    return t(s, d, "documents").join(t(s, d, "labels"), "doc_id").select(
        "doc_id", F.col("quality").alias("y"), (F.col("n_chars") % 97).cast("double").alias("score"), F.when(F.col("n_chars") % 3 == 0, 0).otherwise(1).alias("yhat"), "lang", "n_chars"
    )


@q("a19_binary_confusion", f"WITH {SCORED}, c AS (SELECT count(*) FILTER (WHERE y=1 AND yhat=1) AS tp, count(*) FILTER (WHERE y=0 AND yhat=1) AS fp, count(*) FILTER (WHERE y=1 AND yhat=0) AS fn FROM s) SELECT round(tp/(tp+fp),6) AS precision, round(tp/(tp+fn),6) AS recall, round(2*tp/(2*tp+fp+fn),6) AS f1 FROM c")
def _(s, d):
    y, p = F.col("y") == 1, F.col("yhat") == 1
    c = scored(s, d).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(F.round(tp / (tp + fp), 6).alias("precision"), F.round(tp / (tp + fn), 6).alias("recall"), F.round(2 * tp / (2 * tp + fp + fn), 6).alias("f1"))


_PRED = "p AS (SELECT lang AS truth, CASE WHEN n_chars % 11 = 0 THEN NULL WHEN n_chars % 5 = 0 THEN 'en' ELSE lang END AS pred FROM documents)"
_CLASSES = f"""{_PRED}, l AS (SELECT truth AS label FROM p UNION SELECT pred FROM p WHERE pred IS NOT NULL),
   r AS (SELECT label, (SELECT count(*) FROM p WHERE truth=label AND pred=label) AS tp, (SELECT count(*) FROM p WHERE truth<>label AND pred=label) AS fp, (SELECT count(*) FROM p WHERE truth=label AND (pred IS NULL OR pred<>label)) AS fn, (SELECT count(*) FROM p WHERE truth=label) AS support FROM l)"""


def predictions(s, d):
    p = F.when(F.col("n_chars") % 11 == 0, F.lit(None)).when(F.col("n_chars") % 5 == 0, "en").otherwise(F.col("lang"))
    return t(s, d, "documents").select(F.col("lang").alias("truth"), p.alias("pred"))


@q("a20_class_report", f"WITH {_CLASSES} SELECT label, tp, fp, fn, support, round(CASE WHEN tp+fp>0 THEN tp/(tp+fp) ELSE 0 END,6) AS precision, round(CASE WHEN tp+fn>0 THEN tp/(tp+fn) ELSE 0 END,6) AS recall, round(CASE WHEN tp>0 THEN 2*tp/(2*tp+fp+fn) ELSE 0 END,6) AS f1 FROM r")
def _(s, d):
    r = SC.class_report(predictions(s, d), "truth", "pred")
    return r.select("label", "tp", "fp", "fn", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@q("a32_macro_f1_fixed", f"WITH {_CLASSES} SELECT round(sum(CASE WHEN tp>0 THEN 2*tp/(2*tp+fp+fn) ELSE 0 END)/5,6) AS macro_f1 FROM r")
def _(s, d):
    labels = s.createDataFrame([(x,) for x in ("en", "de", "fr", "es", "it")], "label string")
    return SC.class_report(predictions(s, d), "truth", "pred", labels).agg(F.round(F.avg("f1"), 6).alias("macro_f1"))


_LONG = "l AS (SELECT doc_id, lang, CASE WHEN n_chars % 4 = 0 THEN NULL ELSE n_chars % 3 END AS truth, CASE WHEN n_chars % 5 = 0 THEN NULL ELSE n_chars % 2 END AS pred FROM documents), o AS (SELECT doc_id, lang, CASE WHEN truth IS NULL AND pred IS NULL THEN 'TRUE_ABSTAIN' WHEN truth IS NULL THEN 'HALLUCINATE' WHEN pred IS NULL THEN 'ABSTAIN' WHEN truth=pred THEN 'HIT' ELSE 'WRONG' END AS outcome FROM l)"


def outcomes(s, d):
    n = F.col("n_chars")
    truth, pred = F.when(n % 4 != 0, n % 3), F.when(n % 5 != 0, n % 2)
    return t(s, d, "documents").select("doc_id", "lang", SC.outcome(truth, pred).alias("outcome"))


@q("d20_five_way", f"WITH {_LONG} SELECT doc_id, outcome FROM o")
def _(s, d):
    return outcomes(s, d).select("doc_id", "outcome")


@q("d21_exact_match", f"WITH {_LONG} SELECT doc_id % 200 AS rec, bool_and(outcome IN ('HIT','TRUE_ABSTAIN')) AS exact FROM o GROUP BY 1")
def _(s, d):
    return SC.exact_match(outcomes(s, d).withColumn("rec", F.col("doc_id") % 200), "rec")


_METRIC = """c AS (SELECT {k} count(*) FILTER (WHERE outcome='HIT') AS h, count(*) FILTER (WHERE outcome='WRONG') AS w, count(*) FILTER (WHERE outcome='ABSTAIN') AS a, count(*) FILTER (WHERE outcome='HALLUCINATE') AS x, count(*) FILTER (WHERE outcome='TRUE_ABSTAIN') AS t FROM o {g}),
   r AS (SELECT *, h/nullif(h+w+x,0) AS p, h/nullif(h+w+a,0) AS rc FROM c) SELECT {k} round(p,6) AS precision, round(rc,6) AS recall, round(x/nullif(x+t,0),6) AS hallucination, round(CASE WHEN p>0 AND rc>0 THEN 2*p*rc/(p+rc) END,6) AS f1 FROM r"""


@q("a21_outcome_totals", f"WITH {_LONG}, " + _METRIC.format(k="", g=""))
def _(s, d):
    return SC.field_metrics(outcomes(s, d), []).select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "hallucination", "f1")])


@q("a22_metrics_by_group", f"WITH {_LONG}, " + _METRIC.format(k="lang,", g="GROUP BY lang"))
def _(s, d):
    return SC.field_metrics(outcomes(s, d), ["lang"]).select("lang", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "hallucination", "f1")])


@q("a23_majority_of_runs", """WITH r AS (SELECT doc_id % 50 AS problem, n_chars % 3 <> 0 AS pass, n_chars AS ms FROM documents), g AS (SELECT problem, count(*) FILTER (WHERE pass)*2 > count(*) AS solved, list_sort(list(ms)) AS l FROM r GROUP BY 1) SELECT problem, solved, l[len(l)//2+1] AS median_ms FROM g""")
def _(s, d):
    r = t(s, d, "documents").select((F.col("doc_id") % 50).alias("problem"), (F.col("n_chars") % 3 != 0).alias("pass"), F.col("n_chars").alias("ms"))
    g = r.groupBy("problem").agg((F.count_if("pass") * 2 > F.count("*")).alias("solved"), F.sort_array(F.collect_list("ms")).alias("l"))
    return g.select("problem", "solved", F.get("l", F.floor(F.size("l") / 2).cast("int")).alias("median_ms"))


@q("a24_index_quantile", "WITH g AS (SELECT lang, list_sort(list(n_chars)) AS l FROM documents GROUP BY 1) SELECT lang, l[least(len(l)-1, floor(0.9*len(l))::BIGINT)+1] AS p90, l[floor(0.5*(len(l)-1))::BIGINT+1] AS p50 FROM g")
def _(s, d):
    from quern.operators.quantiles import index_quantile

    return index_quantile(t(s, d, "documents"), ["lang"], "n_chars", {"p90": (0.9, "n"), "p50": (0.5, "n-1")})


@q("a25_median", "SELECT lang, median(n_chars) AS median FROM documents GROUP BY 1")
def _(s, d):
    return t(s, d, "documents").groupBy("lang").agg(F.median("n_chars").alias("median"))


@q("a26_geometric_mean", "SELECT round(exp(avg(ln(l_extendedprice/l_quantity))),6) AS g FROM lineitem")
def _(s, d):
    return t(s, d, "lineitem").agg(F.round(F.exp(F.avg(F.ln(F.col("l_extendedprice") / F.col("l_quantity")))), 6).alias("g"))


@q("a27_pearson", "SELECT round(corr(l_quantity,l_extendedprice),6) AS r FROM lineitem")
def _(s, d):
    return t(s, d, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


@q("a28_slope", "SELECT round(regr_slope(l_extendedprice,l_quantity),4) AS slope FROM lineitem")
def _(s, d):
    return t(s, d, "lineitem").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"))


@q("a29_roc_auc", f"""WITH {SCORED}, k AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score)-1)/2.0 AS r FROM s) SELECT round(((sum(r) FILTER (WHERE y=1)) - count(*) FILTER (WHERE y=1)*(count(*) FILTER (WHERE y=1)+1)/2.0)/(count(*) FILTER (WHERE y=1)*count(*) FILTER (WHERE y=0)),6) AS auc FROM k""")
def _(s, d):
    return SC.roc_auc(scored(s, d), "y", "score").select(F.round("auc", 6).alias("auc"))


@q("a30_average_precision", f"""WITH {SCORED}, g AS (SELECT score, sum(y) AS p, count(*) AS n FROM s GROUP BY 1), c AS (SELECT p, sum(p) OVER w AS tp, sum(n) OVER w AS seen FROM g WINDOW w AS (ORDER BY score DESC)) SELECT round(sum(p*tp/seen)/sum(p),6) AS ap FROM c""")
def _(s, d):
    return SC.average_precision(scored(s, d), "y", "score").select(F.round("ap", 6).alias("ap"))


@q("a31_mae_vs_median", "WITH m AS (SELECT median(l_extendedprice) AS med FROM lineitem) SELECT round(avg(abs(l_extendedprice - l_quantity*2000)),4) AS mae, round(avg(abs(l_extendedprice-med)),4) AS base FROM lineitem, m")
def _(s, d):
    line = t(s, d, "lineitem")
    m = line.agg(F.median("l_extendedprice").alias("med"))
    p = F.col("l_extendedprice")
    return line.join(F.broadcast(m)).agg(F.round(F.avg(F.abs(p - F.col("l_quantity") * 2000)), 4).alias("mae"), F.round(F.avg(F.abs(p - F.col("med"))), 4).alias("base"))


@q("a39_pool_costs", "WITH g AS (SELECT source, list_sort(list(n_chars)) AS l, sum(n_chars)::BIGINT AS total, count(*) FILTER (WHERE n_chars > 5000) AS long_ FROM documents GROUP BY 1) SELECT source, l[floor(0.5*(len(l)-1))::BIGINT+1] AS median, l[floor(0.9*(len(l)-1))::BIGINT+1] AS p90, list_last(l) AS most, total, long_ FROM g")
def _(s, d):
    from quern.operators.quantiles import index_quantile

    docs = t(s, d, "documents")
    sums = docs.groupBy("source").agg(F.max("n_chars").alias("most"), F.sum("n_chars").alias("total"), F.count_if(F.col("n_chars") > 5000).alias("long_"))
    return index_quantile(docs, ["source"], "n_chars", {"median": (0.5, "n-1"), "p90": (0.9, "n-1")}).join(sums, "source").select("source", "median", "p90", "most", "total", "long_")


@q("a40_budget_what_if", "SELECT b, count(*) FILTER (WHERE n_chars > b) AS past, sum(greatest(0, n_chars-b))::BIGINT AS saved FROM documents, (VALUES (500::BIGINT),(1000),(5000)) v(b) GROUP BY 1")
def _(s, d):
    return t(s, d, "documents").select("n_chars", F.explode(F.array(*[F.lit(x).cast("long") for x in (500, 1000, 5000)])).alias("b")).groupBy("b").agg(F.count_if(F.col("n_chars") > F.col("b")).alias("past"), F.sum(F.greatest(F.lit(0), F.col("n_chars") - F.col("b"))).alias("saved"))


@q("a41_panel_disagreement", "SELECT count(*) FILTER (WHERE len(list_distinct([n_chars % 3, n_chars % 4, n_chars % 5])) > 1) AS disagree, count(*) AS n FROM documents")
def _(s, d):
    n = F.col("n_chars")
    return t(s, d, "documents").agg(F.count_if(F.size(F.array_distinct(F.filter(F.array(n % 3, n % 4, n % 5), lambda x: x.isNotNull()))) > 1).alias("disagree"), F.count("*").alias("n"))


@q("a42_invalid_rates", "SELECT lang, round(avg(CASE WHEN n_chars % 7 = 0 THEN 1.0 ELSE 0 END),6) AS invalid, round(avg(CASE WHEN n_chars % 4 = doc_id % 4 THEN 1.0 ELSE 0 END),6) AS right_count FROM documents GROUP BY 1")
def _(s, d):
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return t(s, d, "documents").groupBy("lang").agg(share(F.col("n_chars") % 7 == 0).alias("invalid"), share(F.col("n_chars") % 4 == F.col("doc_id") % 4).alias("right_count"))


@q("a43_ratio_of_sums", "SELECT lang, round(sum(n_chars % 10)/sum(n_chars % 17),6) AS ratio, array_to_string(list_sort(list(DISTINCT source)),',') AS sources FROM documents GROUP BY 1")
def _(s, d):
    return t(s, d, "documents").groupBy("lang").agg(F.round(F.sum(F.col("n_chars") % 10) / F.sum(F.col("n_chars") % 17), 6).alias("ratio"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


@q("a44_two_level_yield", "WITH r AS (SELECT lang, doc_id % 100 AS k, count(*) AS replies, bool_or(n_chars > 3000) AS kept FROM documents GROUP BY 1,2) SELECT lang, sum(replies)::BIGINT AS replies, count(*) AS n, count(*) FILTER (WHERE kept) AS with_kept FROM r GROUP BY 1")
def _(s, d):
    r = t(s, d, "documents").groupBy("lang", (F.col("doc_id") % 100).alias("k")).agg(F.count("*").alias("replies"), F.bool_or(F.col("n_chars") > 3000).alias("kept"))
    return r.groupBy("lang").agg(F.sum("replies").alias("replies"), F.count("*").alias("n"), F.count_if("kept").alias("with_kept"))


@q("a45_generation_summary", "SELECT event_type, count(*) FILTER (WHERE value > 50) AS limit_hits, round(max(value),6) AS most, (epoch_us(max(ts)) - epoch_us(min(ts)))::BIGINT AS wall_us FROM events GROUP BY 1")
def _(s, d):
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return t(s, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("limit_hits"), F.round(F.max("value"), 6).alias("most"), (us(F.max("ts")) - us(F.min("ts"))).alias("wall_us"))


_VOTES = "v AS (SELECT doc_id % 300 AS id, 'f' || (doc_id % 2) AS field, CASE WHEN n_chars % 6 = 0 THEN NULL ELSE CAST(n_chars % 3 AS VARCHAR) END AS value FROM documents)"


def votes(s, d):
    n = F.col("n_chars")
    return t(s, d, "documents").select((F.col("doc_id") % 300).alias("id"), F.concat(F.lit("f"), (F.col("doc_id") % 2).cast("string")).alias("field"), F.when(n % 6 != 0, (n % 3).cast("string")).alias("value"))


@q("d10_plurality_vote", f"""WITH {_VOTES}, c AS (SELECT id, field, value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY 1,2,3), m AS (SELECT *, max(n) OVER (PARTITION BY id, field) AS top, sum(n) OVER (PARTITION BY id, field) AS total FROM c),
   b AS (SELECT id, field, count(*) AS ways, min(value) AS value, any_value(top) AS top, any_value(total) AS total FROM m WHERE n=top GROUP BY 1,2)
   SELECT k.id, k.field, CASE WHEN ways=1 THEN value END AS consensus, round(top/total,6) AS agreement, coalesce(total,0)::BIGINT AS n_opinions, coalesce(ways<>1,true) AS undecided FROM (SELECT DISTINCT id, field FROM v) k LEFT JOIN b USING (id, field)""")
def _(s, d):
    return SC.plurality_vote(votes(s, d), ["id", "field"]).withColumn("agreement", F.round("agreement", 6))


@q("d16_krippendorff", f"""WITH {_VOTES}, c AS (SELECT id, value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY 1,2), u AS (SELECT *, sum(n) OVER (PARTITION BY id) AS m FROM c), p AS (SELECT * FROM u WHERE m > 1),
   t AS (SELECT sum(n) AS n, sum(n*(m-n)/(m-1)) AS d FROM p), q AS (SELECT sum(nc*nc) AS sq FROM (SELECT sum(n) AS nc FROM p GROUP BY value)) SELECT round(1-(n-1)*d/(n*n-sq),6) AS alpha FROM t, q""")
def _(s, d):
    return SC.krippendorff_alpha(votes(s, d), "id", "value").select(F.round("alpha", 6).alias("alpha"))


@q("t1_bootstrap", None)
def _(s, d):
    docs = t(s, d, "documents").select("doc_id", (F.col("n_chars") % 3 == 0).cast("int").alias("ok"))
    return ST.bootstrap_interval(docs, "doc_id", "ok", 500)


def _pair(s, d):
    docs = t(s, d, "documents")
    return docs.select("doc_id", (F.col("n_chars") % 3 > 0).alias("ok")), docs.select("doc_id", (F.col("n_chars") % 4 > 0).alias("ok"))


@q("t2_mcnemar", """WITH c AS (SELECT count(*) FILTER (WHERE n_chars % 3 > 0 AND n_chars % 4 = 0) AS b, count(*) FILTER (WHERE n_chars % 3 = 0 AND n_chars % 4 > 0) AS c FROM documents UNION ALL VALUES (5, 5), (0, 1), (0, 0))
   SELECT b AS losses, c AS gains, coalesce(round(pow(abs(b-c)-1,2)/nullif(b+c,0),6), 0) AS chi2 FROM c""")
def _(s, d):
    r = ST.paired_counts(*_pair(s, d), "doc_id", "ok").first()
    pairs = [(r["losses"], r["gains"]), (5, 5), (0, 1), (0, 0)]
    return s.createDataFrame([(b, c, round(ST.mcnemar_chi2(b, c)[0], 6)) for b, c in pairs], "losses long, gains long, chi2 double")


_TAIL = "least(1, 2 * (SELECT sum(exp(lgamma({n}+1) - lgamma(i+1) - lgamma({n}-i+1) - {n}*ln(2))) FROM (SELECT unnest(generate_series(0, least({b},{c}))) AS i)))"


@q("t3_exact_mcnemar", "SELECT b, c, round(CASE WHEN b + c = 0 THEN 1 ELSE " + _TAIL.format(n="(b+c)", b="b", c="c") + " END, 9)::DOUBLE AS p FROM (VALUES (0,0),(1,9),(45,74),(5,6)) v(b,c)")
def _(s, d):
    return s.createDataFrame([(b, c, round(ST.mcnemar_exact(b, c), 9)) for b, c in ((0, 0), (1, 9), (45, 74), (5, 6))], "b int, c int, p double")


_LIMITS = """b AS (SELECT k, n, 0 AS step, 0.0::DOUBLE AS l0, 1.0::DOUBLE AS l1, 0.0::DOUBLE AS h0, 1.0::DOUBLE AS h1 FROM kn UNION ALL
     SELECT k, n, step + 1, CASE WHEN lt < 0.025 THEN (l0+l1)/2 ELSE l0 END, CASE WHEN lt < 0.025 THEN l1 ELSE (l0+l1)/2 END, CASE WHEN ht < 0.975 THEN (h0+h1)/2 ELSE h0 END, CASE WHEN ht < 0.975 THEN h1 ELSE (h0+h1)/2 END
     FROM (SELECT *, list_sum(list_transform(generate_series(k, n), lambda i: exp(lgamma(n+1)-lgamma(i+1)-lgamma(n-i+1) + i*ln((l0+l1)/2) + (n-i)*ln(1-(l0+l1)/2)))) AS lt,
       coalesce(list_sum(list_transform(generate_series(k+1, n), lambda i: exp(lgamma(n+1)-lgamma(i+1)-lgamma(n-i+1) + i*ln((h0+h1)/2) + (n-i)*ln(1-(h0+h1)/2)))), 0) AS ht FROM b WHERE step < 50)),
   ci AS (SELECT k, n, round(CASE WHEN k = 0 THEN 0 ELSE (l0+l1)/2 END, 9)::DOUBLE AS low, round(CASE WHEN k = n THEN 1 ELSE (h0+h1)/2 END, 9)::DOUBLE AS high FROM b WHERE step = 50)"""

@q("t4_clopper_pearson", f"WITH RECURSIVE kn(k, n) AS (VALUES (0,10),(10,10),(47,100),(1,400)), {_LIMITS} SELECT * FROM ci")
def _(s, d):
    return s.createDataFrame([(k, n, *(round(x, 9) for x in ST.clopper_pearson(k, n))) for k, n in ((0, 10), (10, 10), (47, 100), (1, 400))], "k int, n int, low double, high double")


@q("t5_paired_summary", f"""WITH RECURSIVE c AS (SELECT count(*) AS n, count(*) FILTER (WHERE n_chars % 3 > 0) AS x, count(*) FILTER (WHERE n_chars % 4 > 0) AS y,
     count(*) FILTER (WHERE n_chars % 3 > 0 AND n_chars % 4 = 0) AS losses, count(*) FILTER (WHERE n_chars % 3 = 0 AND n_chars % 4 > 0) AS gains FROM documents), kn AS (SELECT x AS k, n FROM c), {_LIMITS}
   SELECT c.n, round(x/c.n, 9) AS before, round(y/c.n, 9) AS after, round((y-x)/c.n, 9) AS delta, gains, losses, round({_TAIL.format(n="(gains+losses)", b="gains", c="losses")}, 9)::DOUBLE AS p, low, high FROM c, ci""")
def _(s, d):
    x = ST.paired_summary(*_pair(s, d), "doc_id", "ok")
    r = lambda v: round(v, 9)
    return s.createDataFrame([(x["n"], r(x["before"]), r(x["after"]), r(x["delta"]), x["gains"], x["losses"], r(x["p"]), *map(r, x["before_ci"]))], "n long, before double, after double, delta double, gains long, losses long, p double, low double, high double")


_FISHER = """WITH t(a, b, c, d) AS (VALUES (3,1,1,3),(10,2,3,15)), x AS (SELECT t.*, unnest(generate_series(greatest(0, a+c-(c+d)), least(a+b, a+c))) AS x FROM t),
   l AS (SELECT *, lgamma(a+b+1) - lgamma(x+1) - lgamma(a+b-x+1) + lgamma(c+d+1) - lgamma(a+c-x+1) - lgamma(c+d-(a+c-x)+1) - lgamma(a+b+c+d+1) + lgamma(a+c+1) + lgamma(b+d+1) AS lp FROM x),
   p AS (SELECT *, max(CASE WHEN x = a THEN exp(lp) END) OVER (PARTITION BY a, b, c, d) AS own FROM l)
   SELECT a, b, c, d, round(sum(exp(lp)) FILTER (WHERE exp(lp) <= own * (1 + 1e-9)), 9) AS p FROM p GROUP BY a, b, c, d"""


@q("t6_fisher", _FISHER)
def _(s, d):
    return s.createDataFrame([(*x, round(ST.fisher_exact(*x), 9)) for x in ((3, 1, 1, 3), (10, 2, 3, 15))], "a int, b int, c int, d int, p double")


@q("t7_verdict_rules", "SELECT lang, CASE WHEN avg(quality) >= 0.9 THEN 'target' WHEN avg(quality) < 0.7 THEN 'below' ELSE 'hold' END AS verdict FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def _(s, d):
    a = F.avg("quality")
    return t(s, d, "documents").join(t(s, d, "labels"), "doc_id").groupBy("lang").agg(F.when(a >= 0.9, "target").when(a < 0.7, "below").otherwise("hold").alias("verdict"))


@q("t8_sign_test", "WITH k AS (SELECT count(*) FILTER (WHERE l_tax < l_discount) AS a, count(*) FILTER (WHERE l_tax > l_discount) AS b FROM lineitem) SELECT a AS shorter, b AS longer, round(" + _TAIL.format(n="(a+b)", b="a", c="b") + ", 6)::DOUBLE AS p FROM k")
def _(s, d):
    r = t(s, d, "lineitem").agg(F.count_if(F.col("l_tax") < F.col("l_discount")).alias("a"), F.count_if(F.col("l_tax") > F.col("l_discount")).alias("b")).first()
    return s.createDataFrame([(r["a"], r["b"], round(ST.sign_test(r["a"], r["b"]), 6))], "shorter long, longer long, p double")


@q("t9_detectable_effect", "SELECT round(100*2.8*sqrt(0.1/count(*)),6) AS points FROM documents")
def _(s, d):
    n = t(s, d, "documents").count()
    return s.createDataFrame([(round(ST.minimum_detectable_effect(0.1, n), 6),)], "points double")


@q("t10_paired_report", """WITH x AS (SELECT doc_id, lang, n_chars % 3 > 0 AND n_chars % 7 > 0 AS before, n_chars % 4 > 0 AND n_chars % 7 > 0 AS after, contains(text, '\n') AS leak FROM documents
     WHERE n_chars % 11 > 0 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)), s AS (SELECT lang AS stratum, * FROM x UNION ALL SELECT 'all', * FROM x UNION ALL SELECT 'leak', * FROM x WHERE leak)
   SELECT stratum, count(*) AS n, count(*) FILTER (WHERE before) AS before, count(*) FILTER (WHERE after) AS after, count(*) FILTER (WHERE before AND NOT after) AS losses, count(*) FILTER (WHERE after AND NOT before) AS gains FROM s GROUP BY 1""")
def _(s, d):
    """Items whose gold fails (toxic ones here) and errored ones are left out; an unclosed reply fails in both runs."""
    n, docs = F.col("n_chars"), t(s, d, "documents")
    items = docs.select("doc_id", (n % 3 > 0).alias("before"), (n % 4 > 0).alias("after"), (n % 11 == 0).alias("errored"), (n % 7 == 0).alias("unclosed"), F.array_compact(F.array(F.col("lang"), F.lit("all"), F.when(F.contains("text", F.lit("\n")), "leak"))).alias("strata"))
    return ST.paired_report(items, t(s, d, "labels").filter("toxic = 1"), "doc_id")

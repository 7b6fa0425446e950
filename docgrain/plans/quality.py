"""Classification, routing, evaluation, timing and cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import values as V
from ..functions.values import as_variant
from ..operators import evaluate as E
from ..operators import metrics as M
from ..operators import routing as C
from ..session import stage, work_path
from ..sources import tables
from .registry import query, spread, table

# ---- document types --------------------------------------------------------------------------------

# The corpus is invented prose, so each type is looked for by words that occur in it.
WORDS = {
    "delivery_order": ["outre", "worthless", "ciónado", "nicht"],
    "tax_id": ["que", "heing"],
    "invoice": ["elle", "thand", "tion"],
    "weighing_bill": ["der", "ich", "onth", "esar"],
}


def _count_sql(name: str) -> str:
    return " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in WORDS[name])


TYPES_CTE = f"""
k AS (SELECT doc_id, source, lang, {_count_sql('delivery_order')} AS d, {_count_sql('tax_id')} AS x,
             {_count_sql('invoice')} AS i, {_count_sql('weighing_bill')} AS w FROM documents),
ranked AS (
  SELECT doc_id, source, lang, list_transform(list_sort(list_filter([
      {{'s': -d, 'r': 0, 't': 'delivery_order'}},
      {{'s': CASE WHEN i > 0 AND x > 0 THEN -(i + x) ELSE 0 END, 'r': 1, 't': 'invoice'}},
      {{'s': -w, 'r': 2, 't': 'weighing_bill'}}], lambda e: e.s < 0)), lambda e: e.t) AS ts FROM k),
types AS (SELECT doc_id, source, lang, CASE WHEN len(ts) = 0 THEN ['delivery_order'] ELSE ts END AS ts, len(ts) > 1 AS is_mixed FROM ranked)
"""


def _detected(spark, sf):
    return C.detect_types(spread(table(spark, sf, "documents"), "doc_id"), "text", WORDS)


@query(
    "detect_types",
    f"WITH {TYPES_CTE} SELECT doc_id, array_to_string(ts, ',') AS detected_types, is_mixed FROM types",
)
def detect_types(spark, sf):
    return _detected(spark, sf).select(
        "doc_id", F.array_join("detected_types", ",").alias("detected_types"), "is_mixed"
    )


PROMPTS = {
    "delivery_order": "Read the delivery order.",
    "weighing_bill": "Read the weighing bill.",
    "invoice": "Read the invoice.",
    "petrol_bill": "Read the petrol receipt.",
}


def _routed(spark, sf):
    override = (
        F.when(F.col("source") == "src0", "petrol_bill")
        .when(F.col("source") == "src1", "")
        .when(F.col("source") == "src2", "memo")
    )
    doc_type, reason = C.resolve_doc_type(override, F.get("detected_types", F.lit(0)))
    typed = _detected(spark, sf).select(
        "doc_id", "text", doc_type.alias("doc_type"), reason.alias("reject_reason")
    )
    return C.route_schema(typed, PROMPTS)


@query(
    "route_schema",
    f"""
WITH {TYPES_CTE},
r AS (SELECT doc_id, CASE source WHEN 'src0' THEN 'petrol_bill' WHEN 'src2' THEN NULL ELSE ts[1] END AS doc_type,
             CASE source WHEN 'src2' THEN 'unknown doc_type memo' END AS reject_reason FROM types)
SELECT *, CASE doc_type WHEN 'delivery_order' THEN 'Read the delivery order.' WHEN 'weighing_bill' THEN 'Read the weighing bill.'
       WHEN 'invoice' THEN 'Read the invoice.' WHEN 'petrol_bill' THEN 'Read the petrol receipt.' END AS prompt
FROM r
""",
)
def route_schema(spark, sf):
    return _routed(spark, sf).drop("text")


@query(
    "build_requests",
    """
WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem),
r AS (SELECT *, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1) // 5 AS no,
             count(*) OVER (PARTITION BY l_orderkey) AS n FROM d),
a AS (SELECT l_orderkey, no, n, string_agg('p' || l_linenumber, ',' ORDER BY l_linenumber) AS images FROM r GROUP BY ALL)
SELECT o_orderkey AS document_id, o_orderstatus AS prompt, coalesce(n, 0) AS n_pages, CAST(coalesce(no, 0) AS INT) AS request_no,
       coalesce(images, '') AS images
FROM orders LEFT JOIN a ON l_orderkey = o_orderkey
""",
)
def build_requests(spark, sf):
    docs = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("document_id"), F.col("o_orderstatus").alias("prompt")
    )
    pages = (
        table(spark, sf, "lineitem")
        .select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page_no"))
        .distinct()
        .withColumn("blob_key", F.concat(F.lit("p"), F.col("page_no").cast("string")))
    )
    out = C.build_requests(docs, pages, "vision-default")
    return out.withColumn("images", F.array_join("images", ","))


@query(
    "refine_eligibility",
    """
WITH pg AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
SELECT event_id, user_id AS extraction_run_id,
       CASE WHEN o_orderkey IS NULL THEN 'extraction run not found' WHEN o_orderstatus = 'P' THEN 'scaffold missing or malformed'
            WHEN l_orderkey IS NULL THEN 'page not found' WHEN o_orderpriority = '5-LOW' THEN 'no field keys to refine' END AS reason
FROM events LEFT JOIN orders ON o_orderkey = user_id AND o_orderstatus <> 'F'
LEFT JOIN pg ON l_orderkey = o_custkey AND l_linenumber = 1
""",
)
def refine_eligibility(spark, sf):
    pages = (
        table(spark, sf, "lineitem")
        .select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page_no"))
        .distinct()
    )
    scaffold = F.when(F.col("o_orderstatus") == "P", "[]").otherwise("{}")
    base = table(spark, sf, "orders").filter("o_orderstatus <> 'F'").select(
        F.col("o_orderkey").alias("extraction_run_id"),
        F.col("o_custkey").alias("document_id"),
        as_variant(scaffold).alias("scaffold"),
        F.when(F.col("o_orderpriority") == "5-LOW", 0).otherwise(3).alias("n_keys"),
    )
    asked = table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("extraction_run_id"), F.lit(1).alias("page_no")
    )
    return C.refine_eligibility(base, pages, asked).drop("page_no")


# ---- comparison rules ---------------------------------------------------------------------------------


@query(
    "normalized_match",
    """
WITH p AS (SELECT doc_id, CASE WHEN source = 'src0' THEN NULL ELSE text END AS a,
                  CASE WHEN source IN ('src0', 'src1') THEN NULL WHEN lang = 'en' THEN ' ' || replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), ' ', '  ') ELSE text || '.' END AS b
           FROM documents)
SELECT doc_id, trim(regexp_replace(lower(a), '\\s+', ' ', 'g')) IS NOT DISTINCT FROM trim(regexp_replace(lower(b), '\\s+', ' ', 'g')) AS is_match
FROM p
""",
)
def normalized_match(spark, sf):
    src = F.col("source")
    capitals = F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    spaced = F.concat(F.lit(" "), F.replace(capitals, F.lit(" "), F.lit("  ")))
    a = F.when(src != "src0", F.col("text"))
    b = F.when(
        ~src.isin("src0", "src1"),
        F.when(F.col("lang") == "en", spaced).otherwise(F.concat("text", F.lit("."))),
    )
    docs = spread(table(spark, sf, "documents"), "doc_id")
    return docs.select("doc_id", V.normalized_match(a, b).alias("is_match"))


@query(
    "numeric_tolerance",
    """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN true WHEN 'P' THEN false ELSE o_orderpriority = '5-LOW' END AS is_match
FROM orders
""",
)
def numeric_tolerance(spark, sf):
    st, price = F.col("o_orderstatus"), F.col("o_totalprice")
    expected = F.when(st == "O", "n/a").otherwise(F.concat(price.cast("string"), F.lit(" t")))
    actual = (
        F.when(st == "F", F.concat((price + 0.005).cast("string"), F.lit("MT ")))
        .when(st == "P", (price + 1).cast("string"))
        .otherwise(F.when(F.col("o_orderpriority") == "5-LOW", "n/a").otherwise("N/A"))
    )
    return table(spark, sf, "orders").select(
        "o_orderkey", V.numeric_tolerance(expected, actual).alias("is_match")
    )


# ---- accuracy --------------------------------------------------------------------------------------------


def _cases(spark, sf):
    """Orders as evaluation cases: a small record expected, and one that differs by status."""
    st, key = F.col("o_orderstatus"), F.col("o_orderkey").cast("string")
    pr = F.col("o_orderpriority")

    def record(number, terms, parts, items):
        return F.struct(
            number.alias("invoice_number"), terms.alias("terms"), parts.alias("do_number"),
            items.alias("items"),
        )

    def items(*quantities):
        return F.array(*[F.struct(pr.alias("description"), q.alias("quantity")) for q in quantities])

    null = F.lit(None).cast("string")
    want = record(key, pr, F.array(key, pr), items(key))
    got = record(
        F.concat(F.lit(" "), key),
        F.when(st == "P", null).otherwise(F.lower(pr)),
        F.when(st == "F", F.array(key)).otherwise(F.array(key, F.upper(pr))),
        F.when(st == "O", items(key, key)).otherwise(items(key)),
    )
    return spread(table(spark, sf, "orders"), "o_orderkey").select(
        "o_orderkey", "o_orderpriority", want.alias("expected"),
        F.when(F.col("o_orderpriority") != "1-URGENT", got).alias("actual"),
    )


ACCURACY_CTE = """
f AS (SELECT unnest(['invoice_number', 'terms', 'do_number', 'items']) AS field),
acc AS (
  SELECT o_orderkey, o_orderpriority, field,
         CASE field WHEN 'invoice_number' THEN true WHEN 'terms' THEN o_orderstatus <> 'P'
                    WHEN 'do_number' THEN o_orderstatus <> 'F' ELSE o_orderstatus <> 'O' END AS is_match
  FROM orders JOIN f ON true WHERE o_orderpriority <> '1-URGENT'
  UNION ALL SELECT o_orderkey, o_orderpriority, 'has_output', false FROM orders WHERE o_orderpriority = '1-URGENT')
"""


def _accuracy(spark, sf):
    return E.field_accuracy(_cases(spark, sf), "expected", "actual", ["o_orderkey", "o_orderpriority"])


@query("field_accuracy", f"WITH {ACCURACY_CTE} SELECT o_orderkey, field, is_match FROM acc")
def field_accuracy(spark, sf):
    return _accuracy(spark, sf).drop("o_orderpriority")


@query(
    "accuracy_gate",
    f"""
WITH {ACCURACY_CTE}
SELECT o_orderpriority, count(*) AS n_checks, count(*) FILTER (is_match) AS n_match,
       round(count(*) FILTER (is_match) / count(*), 9) AS accuracy, count(*) FILTER (is_match) / count(*) >= 0.5 AS passed
FROM acc GROUP BY 1
""",
)
def accuracy_gate(spark, sf):
    return E.accuracy_gate(_accuracy(spark, sf), "o_orderpriority").withColumn(
        "accuracy", F.round("accuracy", 9)
    )


@query(
    "label_accuracy",
    """
SELECT doc_id, 'quality' AS field,
       CASE WHEN l.doc_id IS NULL THEN false ELSE coalesce(quality = CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END, false) END AS is_match
FROM documents LEFT JOIN labels l USING (doc_id)
""",
)
def label_accuracy(spark, sf):
    field = F.lit("quality").alias("field")
    truth = table(spark, sf, "labels").select("doc_id", field, F.col("quality").alias("value"))
    guess = table(spark, sf, "documents").select(
        "doc_id", field, F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("value")
    )
    return E.field_accuracy_long(truth, guess, ["doc_id"])


@query(
    "fixture_health",
    """
SELECT lang AS dataset, CAST(doc_id AS VARCHAR) AS "case", 'source file missing' AS problem
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'petrol', NULL, 'no cases'
UNION ALL SELECT lang, CAST(doc_id AS VARCHAR), 'invalid record' FROM documents WHERE source = 'src3'
""",
)
def fixture_health(spark, sf):
    errors = F.when(F.col("source") == "src3", F.array(F.lit("unknown:x"))).otherwise(F.array())
    cases = table(spark, sf, "documents").select(
        F.col("lang").alias("dataset"), F.col("doc_id").alias("case"),
        F.col("doc_id").alias("pdf_path"), errors.alias("errors"),
    )
    files = table(spark, sf, "labels").select(F.col("doc_id").alias("path"))
    return E.fixture_health(cases, files, ["en", "fr", "de", "es", "petrol"], "errors")


# ---- boxes -------------------------------------------------------------------------------------------------

IOU_SQL = """greatest(0.0, least(a.r, b.r) - greatest(a.l, b.l)) * greatest(0.0, least(a.b, b.b) - greatest(a.t, b.t))"""


@query(
    "iou_pairs",
    f"""
WITH x AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
                  {{'l': CAST(l_linenumber AS DOUBLE), 't': l_quantity, 'r': l_linenumber + 10.0::DOUBLE, 'b': l_quantity + l_linenumber}} AS a,
                  {{'l': l_linenumber + l_discount * 150, 't': l_quantity, 'r': l_linenumber + l_discount * 150 + 10, 'b': l_quantity + 4}} AS b
           FROM lineitem),
y AS (SELECT *, {IOU_SQL} AS i, (a.r - a.l) * (a.b - a.t) AS aa, (b.r - b.l) * (b.b - b.t) AS bb FROM x)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(CASE WHEN i > 0 THEN i / (aa + bb - i) ELSE 0 END, 9) AS iou FROM y
""",
)
def iou_pairs(spark, sf):
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    shift = n + F.col("l_discount") * 150
    a = G.box(n, q, n + 10, q + n)
    b = G.box(shift, q, shift + 10, q + 4)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(G.iou(a, b), 9).alias("iou")
    )


def _labelled_boxes(spark, sf, status):
    """One box per (order, line number): the widest of the rows that share it."""
    n = F.col("l_linenumber")
    return (
        table(spark, sf, "lineitem")
        .filter(F.col("l_linestatus") == status)
        .groupBy(F.col("l_orderkey").alias("run_id"), n.alias("field_key"))
        .agg(F.max("l_quantity").alias("q"))
        .select(
            "run_id", "field_key", F.col("q").cast("int").cast("string").alias("fragment_id"),
            G.box(F.lit(0), F.lit(0), F.col("q"), F.lit(10)).alias("bbox"),
        )
    )


def _order_ids(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"))


TRUTH_CTE = """
g AS (SELECT l_orderkey, l_linenumber, l_linestatus AS st, max(l_quantity) AS q FROM lineitem GROUP BY ALL),
s AS (SELECT t.l_orderkey, count(*) AS n, count(*) FILTER (t.q = p.q) AS hits,
             sum(CASE WHEN p.q IS NULL THEN 0 ELSE least(t.q, p.q) / greatest(t.q, p.q) END) AS total
      FROM g t LEFT JOIN g p ON p.l_orderkey = t.l_orderkey AND p.l_linenumber = t.l_linenumber AND p.st = 'O'
      WHERE t.st = 'F' GROUP BY 1)
"""


@query(
    "fragment_accuracy",
    f"""
WITH {TRUTH_CTE}
SELECT o_orderkey AS run_id, coalesce(n, 0) AS n_truth, round(coalesce(hits / n, 1.0), 9) AS accuracy
FROM orders LEFT JOIN s ON l_orderkey = o_orderkey
""",
)
def fragment_accuracy(spark, sf):
    out = E.classification_accuracy(
        _labelled_boxes(spark, sf, "O"), _labelled_boxes(spark, sf, "F"), _order_ids(spark, sf)
    )
    return out.withColumn("accuracy", F.round("accuracy", 9))


@query(
    "iou_macro",
    f"""
WITH {TRUTH_CTE}
SELECT o_orderkey AS run_id, coalesce(n, 0) AS n_truth, round(coalesce(total / n, 0.0), 9) AS iou_macro
FROM orders LEFT JOIN s ON l_orderkey = o_orderkey
""",
)
def iou_macro(spark, sf):
    out = E.iou_macro(
        _labelled_boxes(spark, sf, "O"), _labelled_boxes(spark, sf, "F"), _order_ids(spark, sf)
    )
    return out.withColumn("iou_macro", F.round("iou_macro", 9))


# ---- timing and cost -----------------------------------------------------------------------------------------


def log_lines(spark, sf):
    """Events as lines of a request log; sign-ups are lines of another kind."""
    status = F.when(F.col("event_type") == "error", 503).otherwise(200)
    line = F.when(
        F.col("event_type") != "signup",
        F.format_string(
            "%s /%s -> %d in %.2fms",
            F.when(F.col("event_type") == "purchase", "POST").otherwise("GET"),
            "event_type", status, "value",
        ),
    ).otherwise("user signed up")
    return table(spark, sf, "events").select("ts", line.alias("line"))


@query(
    "request_timing",
    """
SELECT CASE event_type WHEN 'purchase' THEN 'POST' ELSE 'GET' END AS method, '/' || event_type AS path, count(*) AS n,
       round(avg(value), 6) AS mean_ms, round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms,
       round(quantile_cont(value, 0.99), 6) AS p99_ms, CAST(CASE event_type WHEN 'error' THEN 1 ELSE 0 END AS DOUBLE) AS error_share
FROM events WHERE event_type <> 'signup' GROUP BY event_type
""",
)
def request_timing(spark, sf):
    out = M.request_timing(log_lines(spark, sf), "line", exact=True)
    return out.select(
        "method", "path", "n",
        *[F.round(c, 6).alias(c) for c in ("mean_ms", "p50_ms", "p95_ms", "p99_ms")], "error_share",
    )


@query(
    "timing_over_days",
    """
SELECT CASE event_type WHEN 'purchase' THEN 'POST' ELSE 'GET' END AS method, '/' || event_type AS path, count(*) AS n,
       round(avg(value), 6) AS mean_ms, true AS p50_within, true AS p95_within, true AS p99_within
FROM events WHERE event_type <> 'signup' AND ts >= (SELECT min(date_trunc('day', ts)) + INTERVAL 2 DAY FROM events) GROUP BY event_type
""",
)
def timing_over_days(spark, sf):
    """Sketches stored per route and day, merged over all days but the first two; the ranks of the merged
    percentiles among the requests themselves are within one per cent."""
    verb = F.when(F.col("event_type") == "purchase", "POST").otherwise("GET")
    requests = table(spark, sf, "events").filter("event_type <> 'signup'").select(
        verb.alias("method"), F.concat(F.lit("/"), "event_type").alias("path"), F.lit(200).alias("status"),
        F.col("value").alias("ms"), F.col("ts").cast("timestamp").alias("ts"),
    )
    first = table(spark, sf, "events").agg(F.date_trunc("day", F.min(F.col("ts").cast("timestamp")))).first()[0]
    stored = stage(M.timing_sketches(requests), "timing-sketches")
    late = F.lit(first) + F.expr("INTERVAL 2 DAYS")
    found = M.timing_over(stored.filter(F.col("period") >= late))
    route = ["method", "path"]
    percents = {f"p{p}": F.col(f"p{p}_ms_kll") for p in M.PERCENTS}
    ranked = requests.filter(F.col("ts") >= late).join(found.select(*route, "n", "mean_ms", *[f"{c}_ms_kll" for c in percents]), route)
    below = [F.count_if(F.col("ms") < v).alias(f"{c}_lt") for c, v in percents.items()] + [F.count_if(F.col("ms") <= v).alias(f"{c}_le") for c, v in percents.items()]
    counted = ranked.groupBy(*route, "n", "mean_ms").agg(*below)
    within = [
        ((F.col(f"p{p}_lt") <= F.col("n") * (p / 100 + 0.01)) & (F.col(f"p{p}_le") >= F.col("n") * (p / 100 - 0.01))).alias(f"p{p}_within")
        for p in M.PERCENTS
    ]
    return counted.select(*route, "n", F.round("mean_ms", 6).alias("mean_ms"), *within)


@query(
    "stage_timing",
    """
WITH s AS (SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS ocr, CAST(sum(o_custkey) AS DOUBLE) AS model,
                  CAST(sum(o_orderkey) AS DOUBLE) AS render FROM orders)
SELECT stage, seconds, round(ocr + model + render, 2) AS total_seconds, round(seconds / (ocr + model + render), 9) AS share
FROM (SELECT 'ocr' AS stage, ocr AS seconds, * FROM s UNION ALL SELECT 'model', model, * FROM s UNION ALL SELECT 'render', render, * FROM s)
""",
)
def stage_timing(spark, sf):
    traces = table(spark, sf, "orders").select(
        F.col("o_totalprice").cast("decimal(18,2)").alias("ocr_seconds"),
        F.col("o_custkey").cast("decimal(18,2)").alias("model_seconds"),
        F.col("o_orderkey").cast("decimal(18,2)").alias("render_seconds"),
    )
    out = M.stage_timing(
        traces, {"ocr": "ocr_seconds", "model": "model_seconds", "render": "render_seconds"}
    )
    return out.select(
        "stage", F.col("seconds").cast("double").alias("seconds"),
        F.round("total_seconds", 2).alias("total_seconds"), F.round("share", 9).alias("share"),
    )


@query(
    "run_duration",
    """
SELECT o_orderpriority AS llm_model, o_orderstatus AS doc_type, count(*) AS n_runs,
       CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total_ms,
       round(sum(CAST(round(o_totalprice * 100) AS BIGINT))::DOUBLE / count(*) / 1000, 1) AS mean_seconds
FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)
""",
)
def run_duration(spark, sf):
    from .registry import runs

    return M.run_duration(runs(spark, sf), ["llm_model", "doc_type"], cube=True)


@query(
    "cost_margin",
    """
WITH u AS (SELECT p_brand AS model, date_trunc('month', l_shipdate) AS m, sum(l_linenumber) AS pages, sum(CAST(l_quantity AS BIGINT)) AS i, sum(l_linenumber) AS o
           FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
pr AS (SELECT p_brand AS model, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY 1 HAVING max(p_size) % 2 = 0),
c AS (SELECT u.model, m, pages, CAST(i * lo * 2 + o * hi * 3 AS BIGINT) AS cost, CAST(pages * hi AS BIGINT) AS revenue, hi IS NOT NULL AS is_priced
      FROM u LEFT JOIN pr ON pr.model = u.model)
SELECT model, CAST(m AS TIMESTAMP) AS month, CAST(pages AS BIGINT) AS pages, CAST(cost AS DOUBLE) / 10000 AS cost, CAST(revenue AS DOUBLE) AS revenue,
       CAST(cost AS DOUBLE) / 10000 / CAST(pages AS DOUBLE) AS cost_per_page, CAST(revenue * 10000 - cost AS DOUBLE) / 10000 AS margin,
       CAST(revenue * 10000 - cost AS DOUBLE) / 10000 * 100 / CAST(revenue AS DOUBLE) AS margin_pct, is_priced
FROM c
""",
)
def cost_margin(spark, sf):
    brands = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("model"))
    usage = (
        table(spark, sf, "lineitem")
        .join(brands, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            "model",
            F.col("l_shipdate").alias("created_at"),
            F.col("l_linenumber").cast("long").alias("pages"),
            F.col("l_quantity").cast("long").alias("input_units"),
            F.col("l_linenumber").cast("long").alias("output_units"),
        )
    )
    money = "decimal(12,4)"
    prices = (
        table(spark, sf, "part")
        .groupBy(F.col("p_brand").alias("model"))
        .agg(
            (F.min("p_size").cast(money) * F.lit("0.0002").cast(money)).cast(money).alias("in_price"),
            (F.max("p_size").cast(money) * F.lit("0.0003").cast(money)).cast(money).alias("out_price"),
            F.max("p_size").cast(money).alias("page_price"),
        )
        .filter("page_price % 2 = 0")  # the others have no price
    )
    out = M.cost_and_margin(usage, prices)
    exact = ["cost", "revenue", "margin"]
    return out.select(*[F.col(c).cast("double").alias(c) if c in exact else F.col(c) for c in out.columns])


@query(
    "throughput",
    """
WITH d AS (SELECT o_orderpriority AS model, CAST(o_orderdate AS DATE) AS day, sum(o_custkey) AS pages, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS ms FROM orders GROUP BY ALL)
SELECT model, day, CAST(pages AS BIGINT) AS pages, CAST(ms AS BIGINT) AS duration_ms,
       round(pages * 3600 / (ms / 1000), 6) AS pages_per_hour, round(pages * 3600 / (ms / 1000) / 48.0, 6) AS headroom
FROM d
""",
)
def throughput(spark, sf):
    from .registry import runs

    rows = runs(spark, sf).select(
        F.col("llm_model").alias("model"), "created_at", F.col("document_id").alias("pages"), "duration_ms"
    )
    return M.throughput(rows, 48.0).select(
        "model", "day", "pages", "duration_ms",
        F.round("pages_per_hour", 6).alias("pages_per_hour"), F.round("headroom", 6).alias("headroom"),
    )


# ---- evaluators named by data sets -----------------------------------------------------------------------

# Data sets are the order priorities, each with evaluators of its own.
DATASET_EVALUATORS = {
    "1-URGENT": ["FieldAccuracy"],
    "2-HIGH": ["NormalizedStringMatch", "Fuzzy"],
    "3-MEDIUM": ["FieldAccuracy", "NormalizedStringMatch"],
    "4-NOT SPECIFIED": ["Exact"],
    "5-LOW": ["NumericTolerance"],
}


def _datasets(spark, sf):
    """The data sets that occur, written as JSON lines and loaded, and their cases with an output."""
    names = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in DATASET_EVALUATORS.items() for x in pair])
    orders = table(spark, sf, "orders")
    listed = F.transform(F.try_element_at(names, "name"), lambda n: F.struct(n.alias("name")))
    path = work_path(spark, "datasets")
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")

    def record(number, tags, weight):
        fields = F.struct(number.alias("number"), F.array(*tags).alias("tags"))
        return F.when(F.col("o_orderpriority") == "5-LOW", weight).otherwise(F.to_json(fields))

    weight = F.round(F.col("o_totalprice")).cast("long")
    case = F.struct(
        key.cast("string").alias("name"),
        record(key, [status, F.lit("a b")], F.concat(weight.cast("string"), F.lit(".00 t"))).alias("expected_output"),
    )
    sets = orders.groupBy(F.col("o_orderpriority").alias("name")).agg(F.collect_list(case).alias("cases"))
    sets.select("name", listed.alias("evaluators"), "cases").write.json(path)
    cases, datasets = tables.load_eval_datasets(spark, path)
    changed = F.when(key % 3 == 0, key + 1).otherwise(key)
    heavier = F.when(key % 3 == 0, weight + 1).otherwise(weight).cast("string")
    actual = F.when(key % 7 != 0, record(changed, [F.lower(status), F.lit(" A  b")], heavier))
    outputs = orders.select(key.cast("string").alias("case"), actual.alias("actual"))
    return cases.select("dataset", "case", "expected").join(outputs, "case"), datasets


@query(
    "dataset_evaluators",
    """
WITH o AS (SELECT o_orderpriority AS dataset, CAST(o_orderkey AS VARCHAR) AS "case", o_orderkey % 7 = 0 AS gone, o_orderkey % 3 <> 0 AS same FROM orders)
SELECT dataset, "case", 'FieldAccuracy' AS evaluator, 'has_output' AS field, false AS is_match FROM o WHERE dataset IN ('1-URGENT', '3-MEDIUM') AND gone
UNION ALL SELECT dataset, "case", 'FieldAccuracy', 'number', same FROM o WHERE dataset IN ('1-URGENT', '3-MEDIUM') AND NOT gone
UNION ALL SELECT dataset, "case", 'FieldAccuracy', 'tags', true FROM o WHERE dataset IN ('1-URGENT', '3-MEDIUM') AND NOT gone
UNION ALL SELECT dataset, "case", 'NormalizedStringMatch', 'output', false FROM o WHERE dataset IN ('2-HIGH', '3-MEDIUM')
UNION ALL SELECT dataset, "case", 'NumericTolerance', 'output', same AND NOT gone FROM o WHERE dataset = '5-LOW'
""",
)
def dataset_evaluators(spark, sf):
    return E.evaluate_datasets(*_datasets(spark, sf))[0]


@query(
    "unknown_evaluators",
    """
SELECT DISTINCT o_orderpriority AS dataset, CASE o_orderpriority WHEN '2-HIGH' THEN 'Fuzzy' ELSE 'Exact' END AS evaluator,
       'unknown evaluator' AS reason
FROM orders WHERE o_orderpriority IN ('2-HIGH', '4-NOT SPECIFIED')
""",
)
def unknown_evaluators(spark, sf):
    return E.evaluate_datasets(*_datasets(spark, sf))[1]

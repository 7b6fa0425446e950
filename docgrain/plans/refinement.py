"""Refinement patches over fragments.

A document is an extraction run and its text lines are the OCR fragments. A refinement pass
proposed one patch per line; the wording of the line decides which.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.values import as_variant
from ..operators import metrics as M
from ..operators import refine as P
from .registry import LINES_CTE, lines, query, spread, table


def fragments(spark, sf):
    n, size = F.col("line_no"), F.length("line")
    return lines(spark, sf).select(
        F.col("doc_id").alias("run_id"),
        n.cast("long").alias("frag_ord"),
        # Lines of equal length share a reference, so the later one takes it over.
        F.concat(F.lit("#/texts/"), size.cast("string")).alias("self_ref"),
        F.lit(None).cast("string").alias("id"),
        F.col("line").alias("text"),
        G.box(n, size, n + 10, size + 5).alias("bbox"),
        F.lit("ocr").alias("source"),
        F.lit(None).cast("double").alias("confidence"),
    )


def patches(spark, sf):
    line, n, size = F.col("line"), F.col("line_no"), F.length("line")
    first = F.substring(line, 1, 1)
    op = (
        F.when(first < "C", "assign").when(first < "L", "move").when(first < "T", "reject")
        .otherwise("add")
    )
    target = (
        F.when(size > 200, F.concat(F.lit("#/texts/"), size.cast("string")))
        .when(size > 100, F.concat(F.lit("f"), (n + 1).cast("string")))
        .otherwise(F.concat(F.lit("#/texts/"), (size + 1).cast("string")))
    )
    x0 = n * 10
    right = F.when(F.contains(line, F.lit("|")), x0 - 1).otherwise(x0 + 50)
    normed = F.contains(line, F.lit("th"))
    boxed = op.isin("add", "move")
    return lines(spark, sf).select(
        F.col("doc_id").alias("run_id"),
        n.cast("long").alias("patch_ord"),
        op.alias("op"),
        F.when(op != "add", target).alias("fragment_id"),
        F.when(size >= 20, F.concat(F.lit("k"), F.substring(line, 2, 1))).alias("field_key"),
        F.when(boxed & ~normed, G.box(size, n, size + 5, n + 7)).alias("new_bbox"),
        F.when(boxed & normed, F.array(x0, size, right, size + 100)).alias("box_2d"),
        F.when((op == "add") & ~F.contains(line, F.lit("#")), line).alias("new_text"),
        F.lit("seen").alias("reason"),
        F.when(F.contains(line, F.lit(",")), 0.9).when(size > 60, 0.5).otherwise(0.3).alias("confidence"),
    )


def run_sizes(spark, sf):
    lang = F.col("lang")
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("run_id"),
        F.when(lang == "en", F.lit(600.0)).alias("page_w"),
        F.when(lang == "en", F.lit(800.0)).alias("page_h"),
        F.when(lang == "fr", F.lit(3)).alias("n_refined"),
    )


def patched(spark, sf):
    return P.apply_patches(fragments(spark, sf), patches(spark, sf), run_sizes(spark, sf))


PATCH_CTE = f"""
{LINES_CTE},
fr AS (
  SELECT doc_id AS run_id, line_no AS frag_ord, '#/texts/' || length(line) AS self_ref, line AS text,
         CAST(line_no AS DOUBLE) AS l, CAST(length(line) AS DOUBLE) AS t, CAST(line_no + 10 AS DOUBLE) AS r, CAST(length(line) + 5 AS DOUBLE) AS b
  FROM ln),
p0 AS (
  SELECT doc_id AS run_id, line_no AS patch_ord, line, line_no AS n, length(line) AS q, contains(line, 'th') AS normed,
         CASE WHEN substr(line, 1, 1) < 'C' THEN 'assign' WHEN substr(line, 1, 1) < 'L' THEN 'move'
              WHEN substr(line, 1, 1) < 'T' THEN 'reject' ELSE 'add' END AS op,
         CASE WHEN contains(line, ',') THEN 0.9::DOUBLE WHEN length(line) > 60 THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END AS confidence
  FROM ln),
p1 AS (
  SELECT *, CASE WHEN op = 'add' THEN NULL WHEN q > 200 THEN '#/texts/' || q WHEN q > 100 THEN 'f' || (n + 1) ELSE '#/texts/' || (q + 1) END AS fragment_id,
         CASE WHEN q >= 20 THEN 'k' || substr(line, 2, 1) END AS field_key,
         CASE WHEN op = 'add' AND NOT contains(line, '#') THEN line END AS new_text
  FROM p0),
idx AS (
  SELECT run_id, alias, max(frag_ord) AS frag_ord
  FROM (SELECT run_id, frag_ord, self_ref AS alias FROM fr UNION ALL SELECT run_id, frag_ord, 'f' || frag_ord FROM fr)
  GROUP BY ALL),
sz AS (SELECT doc_id AS run_id, CASE WHEN lang = 'en' THEN 600.0 ELSE 595.44 END::DOUBLE AS w,
              CASE WHEN lang = 'en' THEN 800.0 ELSE 842.04 END::DOUBLE AS h, CASE WHEN lang = 'fr' THEN 3 ELSE 0 END AS prior FROM documents),
p2 AS (
  SELECT p1.*, i.frag_ord, prior,
         op IN ('add', 'move') AND normed AND contains(line, '|') AS no_box,
         CASE WHEN normed THEN n * 10 * (w / 1000) ELSE q END AS l,
         CASE WHEN normed THEN q * (h / 1000) ELSE n END AS t,
         CASE WHEN normed THEN (n * 10 + 50) * (w / 1000) ELSE q + 5 END AS r,
         CASE WHEN normed THEN (q + 100) * (h / 1000) ELSE n + 7 END AS b
  FROM p1 LEFT JOIN idx i ON i.run_id = p1.run_id AND i.alias = p1.fragment_id LEFT JOIN sz ON sz.run_id = p1.run_id),
jd AS (
  SELECT *, CASE WHEN confidence < 0.5 THEN 'low'
                 WHEN op = 'assign' AND field_key IS NULL THEN 'violation'
                 WHEN op = 'add' AND (new_text IS NULL OR no_box) THEN 'violation'
                 WHEN op <> 'add' AND frag_ord IS NULL THEN 'orphan'
                 WHEN op = 'move' AND no_box THEN 'violation' ELSE 'applied' END AS outcome
  FROM p2),
bad AS (SELECT DISTINCT run_id FROM jd WHERE outcome = 'violation'),
okp AS (SELECT * FROM jd WHERE run_id NOT IN (SELECT run_id FROM bad)),
ap AS (SELECT * FROM okp WHERE outcome = 'applied'),
ad AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY patch_ord) - 1 + prior AS refined_no FROM ap WHERE op = 'add'),
mv AS (SELECT *, row_number() OVER (PARTITION BY run_id, frag_ord ORDER BY patch_ord) AS move_no,
              lag(l) OVER (PARTITION BY run_id, frag_ord ORDER BY patch_ord) AS pl,
              lag(b) OVER (PARTITION BY run_id, frag_ord ORDER BY patch_ord) AS pb FROM ap WHERE op = 'move')
"""


@query(
    "apply_patches_assign",
    f"""
WITH {PATCH_CTE},
a AS (SELECT run_id, patch_ord, field_key, fragment_id, confidence FROM ap WHERE op = 'assign'
      UNION ALL SELECT run_id, patch_ord, field_key, '#/refined-texts/' || refined_no, confidence FROM ad WHERE field_key IS NOT NULL)
SELECT run_id, field_key, arg_max(fragment_id, patch_ord) AS fragment_id, round(arg_max(confidence, patch_ord), 6) AS confidence,
       max(patch_ord) AS patch_ord
FROM a GROUP BY run_id, field_key
""",
)
def apply_patches_assign(spark, sf):
    return patched(spark, sf).assignments.select(
        "run_id", "field_key", "fragment_id", F.round("confidence", 6).alias("confidence"), "patch_ord"
    )


@query(
    "apply_patches_reject",
    f"WITH {PATCH_CTE} SELECT run_id, patch_ord, fragment_id, frag_ord FROM ap WHERE op = 'reject'",
)
def apply_patches_reject(spark, sf):
    return patched(spark, sf).rejected.select("run_id", "patch_ord", "fragment_id", "frag_ord")


@query(
    "apply_patches_add",
    f"""
WITH {PATCH_CTE}
SELECT run_id, patch_ord, '#/refined-texts/' || refined_no AS fragment_id, field_key, new_text AS text,
       round(l, 6) AS l, round(t, 6) AS t, round(r, 6) AS r, round(b, 6) AS b FROM ad
""",
)
def apply_patches_add(spark, sf):
    return patched(spark, sf).added.select(
        "run_id", "patch_ord", "fragment_id", "field_key", "text",
        *[F.round(F.col("bbox").getField(s), 6).alias(s) for s in "ltrb"],
    )


@query(
    "apply_patches_move",
    f"""
WITH {PATCH_CTE}
SELECT mv.run_id, mv.patch_ord, mv.frag_ord, move_no, round(coalesce(pl, fr.l), 6) AS before_l, round(coalesce(pb, fr.b), 6) AS before_b,
       round(mv.l, 6) AS after_l, round(mv.b, 6) AS after_b
FROM mv JOIN fr ON fr.run_id = mv.run_id AND fr.frag_ord = mv.frag_ord
""",
)
def apply_patches_move(spark, sf):
    return patched(spark, sf).moved.select(
        "run_id", "patch_ord", "frag_ord", "move_no",
        F.round("before.l", 6).alias("before_l"), F.round("before.b", 6).alias("before_b"),
        F.round("after.l", 6).alias("after_l"), F.round("after.b", 6).alias("after_b"),
    )


@query(
    "apply_patches_low",
    f"WITH {PATCH_CTE} SELECT run_id, patch_ord, op, fragment_id FROM okp WHERE outcome = 'low'",
)
def apply_patches_low(spark, sf):
    return patched(spark, sf).low.select("run_id", "patch_ord", "op", "fragment_id")


@query(
    "apply_patches_orphan",
    f"WITH {PATCH_CTE} SELECT run_id, patch_ord, op, fragment_id FROM okp WHERE outcome = 'orphan'",
)
def apply_patches_orphan(spark, sf):
    return patched(spark, sf).orphans.select("run_id", "patch_ord", "op", "fragment_id")


@query(
    "contract_violations",
    f"WITH {PATCH_CTE} SELECT run_id, patch_ord, op FROM jd WHERE outcome = 'violation'",
)
def contract_violations(spark, sf):
    return P.contract_violations(patches(spark, sf), fragments(spark, sf), run_sizes(spark, sf))


@query(
    "apply_patches_fragments",
    f"""
WITH {PATCH_CTE},
lm AS (SELECT run_id, frag_ord, arg_max(l, move_no) AS l, arg_max(b, move_no) AS b FROM mv GROUP BY ALL),
cnt AS (SELECT run_id, max(frag_ord) + 1 AS n_frag FROM fr GROUP BY 1),
f1 AS (SELECT fr.run_id, fr.frag_ord, self_ref, text, coalesce(lm.l, fr.l) AS l, coalesce(lm.b, fr.b) AS b, 'ocr' AS source
       FROM fr LEFT JOIN lm ON lm.run_id = fr.run_id AND lm.frag_ord = fr.frag_ord
       WHERE fr.run_id NOT IN (SELECT run_id FROM bad)),
f2 AS (SELECT ad.run_id, coalesce(n_frag, 0) + refined_no - prior AS frag_ord, '#/refined-texts/' || refined_no AS self_ref, new_text AS text, l, b, 'vlm' AS source
       FROM ad LEFT JOIN cnt ON cnt.run_id = ad.run_id)
SELECT run_id, frag_ord, self_ref, text, round(l, 6) AS l, round(b, 6) AS b, source FROM f1
UNION ALL SELECT run_id, frag_ord, self_ref, text, round(l, 6), round(b, 6), source FROM f2
""",
)
def apply_patches_fragments(spark, sf):
    return patched(spark, sf).fragments.select(
        "run_id", "frag_ord", "self_ref", "text",
        F.round("bbox.l", 6).alias("l"), F.round("bbox.b", 6).alias("b"), "source",
    )


@query(
    "visible_fragments",
    f"""
WITH {PATCH_CTE}, rj AS (SELECT DISTINCT run_id, frag_ord FROM ap WHERE op = 'reject')
SELECT fr.run_id, fr.frag_ord, text FROM fr LEFT JOIN rj ON rj.run_id = fr.run_id AND rj.frag_ord = fr.frag_ord
WHERE rj.run_id IS NULL AND fr.run_id NOT IN (SELECT run_id FROM bad)
""",
)
def visible_fragments(spark, sf):
    return patched(spark, sf).visible.select("run_id", "frag_ord", "text")


@query(
    "apply_patches_twice",
    f"""
WITH {PATCH_CTE},
lm AS (SELECT run_id, frag_ord, arg_max(l, move_no) AS l FROM mv GROUP BY ALL),
cnt AS (SELECT run_id, max(frag_ord) + 1 AS n_frag FROM fr GROUP BY 1),
na AS (SELECT run_id, count(*) AS n_added FROM ad GROUP BY 1),
doc AS (SELECT sz.run_id, prior, coalesce(n_added, 0) AS n_added, n_frag, sz.run_id IN (SELECT run_id FROM bad) AS gone
        FROM sz LEFT JOIN cnt USING (run_id) LEFT JOIN na USING (run_id))
SELECT doc.run_id, '#/refined-texts/' || (prior + n_added) AS fragment_id,
       CASE WHEN gone THEN 0 ELSE n_frag + n_added END AS frag_ord,
       round(CASE WHEN gone THEN NULL ELSE coalesce(lm.l, fr.l) END, 6) AS before_l,
       n_added + 1 AS n_added_in_all, CASE WHEN gone THEN 0::BIGINT ELSE 1 END AS n_moved_now
FROM doc LEFT JOIN lm ON lm.run_id = doc.run_id AND lm.frag_ord = 0 LEFT JOIN fr ON fr.run_id = doc.run_id AND fr.frag_ord = 0
""",
)
def apply_patches_twice(spark, sf):
    """A second pass over the result of the first: a fragment is added and the first one moved."""
    first = patched(spark, sf)
    ids = run_sizes(spark, sf).select("run_id")
    place = G.box(F.lit(1), F.lit(2), F.lit(3), F.lit(4))
    none = F.lit(None).cast("string")
    again = [("add", none, F.lit("k2"), F.lit("second")), ("move", F.lit("f0"), none, none)]
    rows = [
        F.struct(
            F.lit(i).cast("long").alias("patch_ord"), F.lit(op).alias("op"), target.alias("fragment_id"),
            key.alias("field_key"), place.alias("new_bbox"), F.lit(None).cast("array<int>").alias("box_2d"),
            text.alias("new_text"), F.lit("seen").alias("reason"), F.lit(0.9).alias("confidence"),
        )
        for i, (op, target, key, text) in enumerate(again)
    ]
    second = P.apply_patches(
        first.fragments,
        ids.select("run_id", F.inline(F.array(*rows))),
        first.runs,
        prior_assignments=first.assignments,
        prior_trail=first.trail(),
    )
    fresh = second.fragments.filter("text = 'second' AND source = 'vlm'").select(
        "run_id", F.col("self_ref").alias("fragment_id"), "frag_ord"
    )
    moves = second.moved.groupBy("run_id").agg(
        F.round(F.max("before.l"), 6).alias("before_l"), F.count("*").alias("n_moved_now")
    )
    added = second.trail()["added"].groupBy("run_id").agg(F.count("*").alias("n_added_in_all"))
    return (
        fresh.join(moves, "run_id", "left")
        .join(added, "run_id", "left")
        .withColumn("n_moved_now", F.coalesce("n_moved_now", F.lit(0).cast("long")))
    )


@query(
    "confidence_gate",
    f"""
WITH {PATCH_CTE}
SELECT run_id, count(*) FILTER (confidence >= 0.5) AS n_pass, count(*) FILTER (confidence < 0.5) AS n_low FROM p0 GROUP BY 1
""",
)
def confidence_gate(spark, sf):
    passed, low = P.confidence_gate(patches(spark, sf))
    both = passed.withColumn("ok", F.lit(True)).unionByName(low.withColumn("ok", F.lit(False)))
    return both.groupBy("run_id").agg(
        F.count_if("ok").alias("n_pass"), F.count_if(~F.col("ok")).alias("n_low")
    )


@query(
    "fragment_index",
    f"WITH {PATCH_CTE} SELECT run_id, alias, frag_ord FROM idx",
)
def fragment_index(spark, sf):
    return P.fragment_index(fragments(spark, sf))


@query(
    "parse_patches",
    """
WITH j AS (SELECT o_orderkey AS run_id, o_orderpriority AS pr FROM orders WHERE o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_orderpriority NOT IN ('5-LOW', '1-URGENT')))
SELECT run_id, CAST(0 AS BIGINT) AS patch_ord, 'assign' AS op, '#/texts/0' AS fragment_id, pr AS field_key, CAST(0.5 AS DOUBLE) AS confidence, CAST(NULL AS DOUBLE) AS l FROM j
UNION ALL SELECT run_id, 1, 'move', 'f0', NULL, 1.0, CAST(run_id AS DOUBLE) FROM j
""",
)
def parse_patches(spark, sf):
    return P.parse_patches(_patch_lists(spark, sf), "patches")[0].select(
        "run_id", "patch_ord", "op", "fragment_id", "field_key", "confidence",
        F.col("new_bbox.l").alias("l"),
    )


@query(
    "refused_patch_lists",
    """
SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus = 'P' THEN 'unknown key' WHEN o_orderpriority = '5-LOW' THEN 'invalid value' ELSE 'not a list' END AS reject_reason
FROM orders WHERE o_orderstatus = 'P' OR (o_orderstatus = 'O' AND o_orderpriority IN ('5-LOW', '1-URGENT'))
""",
)
def refused_patch_lists(spark, sf):
    return P.parse_patches(_patch_lists(spark, sf), "patches")[1]


def _patch_lists(spark, sf):
    """Orders with a two-patch list; pending ones use an unknown key, some open ones a confidence
    above 1 or an object in place of the list."""
    st, pr = F.col("o_orderstatus"), F.col("o_orderpriority")
    high = (st == "O") & (pr == "5-LOW")
    box = G.box(F.col("o_orderkey"), F.lit(1), F.lit(2), F.lit(3))
    head = F.struct(
        F.lit("assign").alias("op"), F.lit("#/texts/0").alias("fragment_id"), pr.alias("field_key"),
        F.lit(None).cast("struct<l:double,t:double,r:double,b:double>").alias("new_bbox"),
        F.lit("seen").alias("reason"), F.when(high, 1.5).otherwise(0.5).alias("confidence"),
        F.when(st == "P", "x").alias("note"),
    )
    tail = F.struct(
        F.lit("move").alias("op"), F.lit("f0").alias("fragment_id"),
        F.lit(None).cast("string").alias("field_key"), box.alias("new_bbox"),
        F.lit("seen").alias("reason"), F.lit(1.0).alias("confidence"),
        F.lit(None).cast("string").alias("note"),
    )
    text = F.to_json(F.array(head, tail))
    whole = F.when((st == "O") & (pr == "1-URGENT"), F.concat(F.lit('{"patches":'), text, F.lit("}")))
    return spread(table(spark, sf, "orders"), "o_orderkey").select(
        F.col("o_orderkey").alias("run_id"), F.coalesce(whole, text).alias("patches")
    )


# ---- geometry, traces, usage ---------------------------------------------------------------------------


@query(
    "norm_box",
    """
WITH b AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_linenumber AS DOUBLE) AS x, l_quantity AS y FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       CAST(round_even(x * (1000 / 612.0::DOUBLE), 0) AS INT) AS x0, CAST(round_even(y * (1000 / 792.0::DOUBLE), 0) AS INT) AS y0,
       round(round_even(x * (1000 / 612.0::DOUBLE), 0) * (612.0::DOUBLE / 1000), 6) AS back_l,
       round(round_even((y + 20) * (1000 / 792.0::DOUBLE), 0) * (792.0::DOUBLE / 1000), 6) AS back_b
FROM b
""",
)
def norm_box(spark, sf):
    w, h = F.lit(612.0), F.lit(792.0)
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        G.bbox_to_norm_box(G.box(n, q, n + 30, q + 20), w, h).alias("norm"),
    )
    back = G.norm_box_to_bbox(F.col("norm"), w, h)
    return rows.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.get("norm", F.lit(0)).alias("x0"), F.get("norm", F.lit(1)).alias("y0"),
        F.round(back.getField("l"), 6).alias("back_l"), F.round(back.getField("b"), 6).alias("back_b"),
    )


@query(
    "first_page_dims",
    """
SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey + 1 AS DOUBLE) ELSE 595.44 END AS page_w,
       CAST(CASE WHEN o_orderstatus = 'F' THEN 800.0 ELSE 842.04 END AS DOUBLE) AS page_h
FROM orders
""",
)
def first_page_dims(spark, sf):
    st = F.col("o_orderstatus")
    width = F.when(st == "F", (F.col("o_custkey") + 1).cast("double")).when(st == "P", F.lit(0.0))
    page = F.struct(F.lit("1").alias("page"), width.alias("width"), F.lit(800.0).alias("height"))
    later = F.struct(F.lit("2").alias("page"), F.lit(1.0).alias("width"), F.lit(1.0).alias("height"))
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.array(page, later).alias("pages")
    )
    return P.first_page_dims(rows, "pages")


def _trace(spark, sf):
    role = F.col("role")
    turn = F.col("turn").cast("string")
    text = F.concat(
        F.lit('{"visual_audit":"'), role, F.lit('","scaffold_match":{"turn":'), turn,
        F.lit('},"discrepancies":'),
        F.when(role == "user", F.concat(F.lit("["), turn, F.lit(',"x"]')))
        .when(role == "assistant", turn)
        .otherwise(F.lit("null")),
        F.lit("}"),
    )
    return table(spark, sf, "conversations").select("conv_id", "turn", as_variant(text).alias("trace"))


@query(
    "coerce_trace",
    """
SELECT conv_id, turn, role AS visual_audit, '{"turn":' || turn || '}' AS scaffold_match,
       CASE role WHEN 'user' THEN '[' || turn || ',"x"]' WHEN 'assistant' THEN CAST(turn AS VARCHAR) ELSE 'None' END AS discrepancies
FROM conversations
""",
)
def coerce_trace(spark, sf):
    rows = _trace(spark, sf).select("conv_id", "turn", P.coerce_trace(F.col("trace")).alias("t"))
    return rows.select("conv_id", "turn", "t.*")


@query(
    "token_usage",
    """
SELECT conv_id, turn, CASE WHEN role <> 'system' THEN CAST(length(text) AS BIGINT) END AS prompt_tokens,
       CASE WHEN role = 'user' THEN turn END AS completion_tokens,
       CASE WHEN role <> 'system' THEN CAST(length(text) + turn AS BIGINT) END AS total_tokens
FROM conversations
""",
)
def token_usage(spark, sf):
    n = F.length("text").cast("string")
    usage = F.concat(
        F.lit('[{"usage":{"prompt_tokens":1}},{"usage":{"prompt_tokens":'), n,
        F.when(F.col("role") == "user", F.concat(F.lit(',"completion_tokens":'), F.col("turn").cast("string"))).otherwise(F.lit("")),
        F.lit(',"total_tokens":'), (F.length("text") + F.col("turn")).cast("string"), F.lit("}}]"),
    )
    history = F.when(F.col("role") == "system", F.lit("[]")).otherwise(usage)
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", P.token_usage(as_variant(history)).alias("u")
    ).select("conv_id", "turn", "u.*")


STATS_CTE = """
runs AS (SELECT conv_id, CASE WHEN bool_or(role = 'system') THEN 'prompted' ELSE 'plain' END AS vlm_model,
                CASE WHEN count(*) > 4 THEN 'long' ELSE 'short' END AS prompt_version,
                sum(length(text)) AS total_tokens, count(*) AS duration_ms FROM conversations GROUP BY 1)
"""


@query(
    "refinement_stats",
    f"""
WITH {STATS_CTE},
pr AS (SELECT conv_id, count(*) FILTER (role = 'user') AS a, count(*) FILTER (role = 'system') AS s, count(*) FILTER (role = 'assistant') AS m,
              count(*) AS n, count(*) FILTER (length(text) < 200) AS low, sum(CASE WHEN length(text) < 200 THEN 0.25 ELSE 0.75 END) AS c
       FROM conversations GROUP BY 1)
SELECT vlm_model, prompt_version, count(*) AS n_runs, CAST(sum(a) AS BIGINT) AS n_assign, CAST(sum(s) AS BIGINT) AS n_add,
       CAST(0 AS BIGINT) AS n_reject, CAST(sum(m) AS BIGINT) AS n_move, CAST(sum(n) AS BIGINT) AS n_patches,
       CAST(sum(low) AS BIGINT) AS n_low, CAST(0 AS BIGINT) AS n_orphan,
       round(CAST(sum(c) AS DOUBLE) / sum(n), 6) AS mean_confidence, round(CAST(sum(low) AS DOUBLE) / sum(n), 6) AS low_rate,
       CAST(0 AS DOUBLE) AS orphan_rate, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(duration_ms) AS BIGINT) AS duration_ms
FROM runs JOIN pr USING (conv_id) GROUP BY ROLLUP (vlm_model, prompt_version)
""",
)
def refinement_stats(spark, sf):
    turns = table(spark, sf, "conversations")
    refinements = turns.groupBy(F.col("conv_id").alias("run_id")).agg(
        F.when(F.bool_or(F.col("role") == "system"), "prompted").otherwise("plain").alias("vlm_model"),
        F.when(F.count("*") > 4, "long").otherwise("short").alias("prompt_version"),
        F.sum(F.length("text")).alias("total_tokens"),
        F.count("*").alias("duration_ms"),
    )
    role, brief = F.col("role"), F.length("text") < 200
    outcomes = turns.select(
        F.col("conv_id").alias("run_id"),
        F.when(role == "user", "assign").when(role == "system", "add").otherwise("move").alias("op"),
        F.when(brief, "low").otherwise("applied").alias("outcome"),
        F.when(brief, 0.25).otherwise(0.75).alias("confidence"),
    )
    out = P.refinement_stats(refinements, outcomes, rollup=True)
    rates = ["mean_confidence", "low_rate", "orphan_rate"]
    return out.select(*[F.round(c, 6).alias(c) if c in rates else F.col(c) for c in out.columns])


@query(
    "token_totals",
    """
SELECT event_type AS model, 'v1' AS prompt_version, CAST(ts AS DATE) AS day, count(*) AS n_calls,
       CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS prompt_tokens,
       CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS completion_tokens,
       CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT) + CAST(floor(value) AS BIGINT)) AS BIGINT) AS total_tokens
FROM events GROUP BY ALL
""",
)
def token_totals(spark, sf):
    prompt = F.get_json_object("props", "$.k").cast("long")
    done = F.floor("value").cast("long")
    usage = table(spark, sf, "events").select(
        F.col("event_type").alias("model"), F.lit("v1").alias("prompt_version"), F.col("ts").alias("created_at"),
        prompt.alias("prompt_tokens"), done.alias("completion_tokens"), (prompt + done).alias("total_tokens"),
    )
    return M.token_totals(usage)

"""Refinement patches: parse, check, apply, audit.

Shapes
------
patches    run_id, patch_ord, op, fragment_id, field_key, new_bbox, box_2d, new_text, reason,
           confidence
fragments  run_id, frag_ord, self_ref, id, text, bbox, source, confidence
runs       run_id, page_w, page_h, n_refined  (one row per run; sizes and count may be null)
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.barrier import compute_once, unroll
from ..functions.text import blank_to_null
from ..functions.values import kind
from ..schemas import A4_PAGE, CONFIDENCE_FLOOR, PATCH_DDL, PATCH_KEYS, PATCH_OPS
from ..session import stage
from .ranking import split_row_number

# Patch positions per ranking bucket: the most rows of one run that one task numbers.
ORD_BUCKET = 100_000


def parse_patches(df: DataFrame, col: str, key: str = "run_id") -> tuple[DataFrame, DataFrame]:
    """JSON patch lists to typed rows with ``patch_ord``, and the runs whose list is refused.

    One bad entry (unknown key, unknown op, missing reason, confidence missing or outside 0..1)
    refuses the whole list.
    """
    allowed = F.array(*[F.lit(k) for k in PATCH_KEYS])
    parsed = df.select(
        key,
        F.ltrim(F.col(col)).startswith("[").alias("is_list"),
        F.from_json(F.col(col), "array<map<string,string>>").alias("raw"),
        F.from_json(F.col(col), PATCH_DDL).alias("typed"),
    )
    raw, typed = F.col("raw"), F.col("typed")
    unknown = F.exists(raw, lambda p: F.size(F.array_except(F.map_keys(p), allowed)) > 0)
    bad_value = F.exists(
        typed,
        lambda p: ~F.coalesce(p["op"].isin(PATCH_OPS), F.lit(False))
        | p["reason"].isNull()
        | ~F.coalesce(p["confidence"].between(0.0, 1.0), F.lit(False)),
    )
    reason = (
        F.when(~F.coalesce("is_list", F.lit(False)), "not a list")
        .when(raw.isNull() | typed.isNull(), "malformed entry")
        .when(F.coalesce(unknown, F.lit(True)), "unknown key")
        .when(F.coalesce(bad_value, F.lit(True)), "invalid value")
    )
    rows = unroll(parsed, F.when(reason.isNull(), typed), [key], "patch_ord", "x")
    good = rows.select(key, F.col("patch_ord").cast("long").alias("patch_ord"), "x.*")
    refused = compute_once(parsed, [key], reason, "reject_reason")
    return good, refused


def confidence_gate(
    patches: DataFrame, floor: float = CONFIDENCE_FLOOR
) -> tuple[DataFrame, DataFrame]:
    """Patches at or above the floor, and those below it."""
    low = F.col("confidence") < floor
    return patches.filter(~low), patches.filter(low)


def fragment_index(fragments: DataFrame) -> DataFrame:
    """(run_id, alias) -> frag_ord.

    A fragment answers to its own reference (self_ref, else id) and to ``f<position>``. When two
    fragments claim an alias the later one gets it, as a later write would.
    """
    place = F.concat(F.lit("f"), F.col("frag_ord").cast("string"))
    own = F.coalesce(blank_to_null(F.col("self_ref")), blank_to_null(F.col("id")), place)
    return (
        fragments.select("run_id", "frag_ord", F.explode(F.array(own, place)).alias("alias"))
        .groupBy("run_id", "alias")
        .agg(F.max("frag_ord").alias("frag_ord"))
    )


def resolve_bbox(page_w: Column, page_h: Column) -> Column:
    """Box of a patch in points: the normalised box first, else the given one."""
    return F.when(
        F.col("box_2d").isNotNull(), G.norm_box_to_bbox(F.col("box_2d"), page_w, page_h)
    ).otherwise(F.col("new_bbox"))


def page_dims_or_default(page_w: Column, page_h: Column) -> tuple[Column, Column]:
    """Size of the first page; missing or zero sizes give A4."""
    known = F.coalesce((page_w != 0) & (page_h != 0), F.lit(False))
    w, h = A4_PAGE
    return F.when(known, page_w).otherwise(F.lit(w)), F.when(known, page_h).otherwise(F.lit(h))


def first_page_dims(scaffolds: DataFrame, pages: str, key: str = "run_id") -> DataFrame:
    """Page size of each run from ``pages``, an array<struct<page,width,height>> in page order."""
    first = F.get(F.col(pages), F.lit(0))
    w, h = page_dims_or_default(first.getField("width"), first.getField("height"))
    return scaffolds.select(key, w.alias("page_w"), h.alias("page_h"))


def _judge(patches: DataFrame, index: DataFrame, floor: float) -> DataFrame:
    """Add ``frag_ord`` and ``outcome`` (low, violation, orphan, applied).

    Only patches that a fragment decides on meet the index; additions, which hold texts, stay where they are.
    """
    named = patches.withColumn("alias", blank_to_null(F.col("fragment_id")))
    asks = (F.col("op") != "add") & ~(F.col("confidence") < floor) & F.col("alias").isNotNull()
    asks = F.coalesce(asks, F.lit(False))
    found = named.filter(asks).join(index, ["run_id", "alias"], "left")
    found = found.unionByName(named.filter(~asks).withColumn("frag_ord", F.lit(None).cast("long")))
    op = F.col("op")
    no_frag = F.col("alias").isNull()
    no_key = blank_to_null(F.col("field_key")).isNull()
    # Whether there is a box does not depend on the page.
    no_box = resolve_bbox(*[F.lit(x) for x in A4_PAGE]).isNull()
    broken = (
        ((op == "assign") & (no_frag | no_key))
        | (op.isin("reject", "move") & no_frag)
        | ((op == "add") & (blank_to_null(F.col("new_text")).isNull() | no_box))
    )
    outcome = (
        F.when(F.col("confidence") < floor, "low")
        .when(broken, "violation")
        .when((op != "add") & F.col("frag_ord").isNull(), "orphan")
        .when((op == "move") & no_box, "violation")
        .otherwise("applied")
    )
    return found.withColumn("outcome", outcome).drop("alias")


def contract_violations(
    patches: DataFrame, fragments: DataFrame, runs: DataFrame, floor: float = CONFIDENCE_FLOOR
) -> DataFrame:
    judged = _judge(patches, fragment_index(fragments), floor)
    return judged.filter("outcome = 'violation'").select("run_id", "patch_ord", "op")


AUDITS = ["low", "orphans", "rejected", "added", "moved"]


def apply_patches(
    fragments: DataFrame,
    patches: DataFrame,
    runs: DataFrame,
    floor: float = CONFIDENCE_FLOOR,
    mode: str = "quarantine",
    prior_assignments: DataFrame | None = None,
    prior_trail: dict[str, DataFrame] | None = None,
    staged: bool = True,
) -> Patched:
    """Apply all patches of all runs at once, with the full audit trail.

    The judged patches feed every output, so they are computed once and staged; leave ``staged``
    off where only one output is read. Nothing else is written, and everything is lazy.

    The order inside a run is carried by ``patch_ord``: the last assignment of a field wins,
    moves of one fragment chain, additions are numbered in order. A run with a patch that breaks
    the contract gives no output in ``quarantine`` mode; ``fail`` mode raises at the first one.

    A further pass takes the ``fragments``, ``runs``, ``assignments`` and ``trail()`` of the pass before it.
    """
    judged = _judge(patches, fragment_index(fragments), floor)
    if staged:
        judged = stage(judged, "judged-patches")
    broken = judged.filter("outcome = 'violation'")
    if mode == "fail":
        for row in broken.select("run_id", "patch_ord", "op").head(1):
            raise ValueError(
                f"patch contract violated: run {row.run_id}, patch {row.patch_ord} ({row.op})"
            )
    bad_runs = broken.select("run_id").distinct()

    def good(df: DataFrame | None) -> DataFrame | None:
        return None if df is None else df.join(bad_runs, "run_id", "left_anti")

    return Patched(
        judged,
        broken.select(*patches.columns),
        bad_runs,
        fragments,
        runs,
        good(prior_assignments),
        {name: good(df) for name, df in (prior_trail or {}).items()},
    )


class Patched:
    """Everything one refinement pass leaves behind, as long tables computed on demand."""

    def __init__(
        self,
        judged: DataFrame,
        violations: DataFrame,
        bad_runs: DataFrame,
        fragments: DataFrame,
        runs: DataFrame,
        prior: DataFrame | None,
        prior_trail: dict[str, DataFrame],
    ) -> None:
        self.violations = violations
        self._raw = violations.columns
        self._judged, self._base, self._given, self._prior = judged, fragments, runs, prior
        self._bad_runs, self._prior_trail = bad_runs, prior_trail

    def _good(self, df: DataFrame) -> DataFrame:
        return df.join(self._bad_runs, "run_id", "left_anti")

    def _all_applied(self, op: str) -> DataFrame:
        """Quarantined runs included."""
        return self._judged.filter((F.col("outcome") == "applied") & (F.col("op") == op))

    def _applied(self, op: str) -> DataFrame:
        return self._good(self._all_applied(op))

    def _set_aside(self, outcome: str) -> DataFrame:
        return self._good(self._judged.filter(F.col("outcome") == outcome)).select(*self._raw)

    def _with_run(self, df: DataFrame) -> DataFrame:
        """Rows of the runs that are not quarantined, with page size and count of the run."""
        given = self._given.select(
            "run_id",
            F.col("page_w").alias("__w"),
            F.col("page_h").alias("__h"),
            F.col("n_refined").cast("long").alias("__prior"),
        )
        facts = given.join(self._bad_runs.withColumn("__bad", F.lit(True)), "run_id", "full")
        return df.join(facts, "run_id", "left").filter("__bad IS NULL").drop("__bad")

    @cached_property
    def _moves(self) -> DataFrame:
        """Applied moves with their boxes in points."""
        box = resolve_bbox(*page_dims_or_default(F.col("__w"), F.col("__h")))
        rows = self._with_run(self._all_applied("move")).withColumn("bbox", box)
        return rows.select("run_id", "frag_ord", "patch_ord", "fragment_id", "bbox", "confidence", "reason")

    @cached_property
    def _quarantined(self) -> DataFrame:
        """Keys of the fragments of quarantined runs. Fragments meet them by key, as they meet moves and
        rejections, so their texts are shuffled once and evenly."""
        return self._base.select("run_id", "frag_ord").join(self._bad_runs, "run_id", "left_semi")

    @cached_property
    def low(self) -> DataFrame:
        """Patches below the confidence floor: recorded, not applied."""
        return self._set_aside("low")

    @cached_property
    def orphans(self) -> DataFrame:
        """Patches whose fragment does not exist: recorded, not applied."""
        return self._set_aside("orphan")

    @cached_property
    def rejected(self) -> DataFrame:
        """Fragments flagged as artifacts; the fragments themselves stay."""
        return self._applied("reject").select(
            "run_id", "patch_ord", "fragment_id", "frag_ord", "confidence", "reason"
        )

    def _numbered_adds(self, more: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Applied additions with ``add_no``, ``fragment_id`` and box. What they need to know of their run, and
        what ``more`` adds, comes with the totals by which they are numbered; the texts are shuffled once."""
        numbered = split_row_number(
            self._all_applied("add"),
            ["run_id"],
            [F.col("patch_ord").asc()],
            name="add_no",
            bucket=F.floor(F.col("patch_ord") / ORD_BUCKET),
            offsets_with=lambda totals: more(self._with_run(totals)),
        )
        number = F.coalesce("__prior", F.lit(0)) + F.col("add_no") - 1
        box = resolve_bbox(*page_dims_or_default(F.col("__w"), F.col("__h")))
        return numbered.withColumn("bbox", box).withColumn(
            "fragment_id", F.concat(F.lit("#/refined-texts/"), number.cast("string"))
        )

    @cached_property
    def added(self) -> DataFrame:
        """New fragments, numbered after those the run already had."""
        return self._numbered_adds(lambda totals: totals).select(
            "run_id",
            "patch_ord",
            "add_no",
            "fragment_id",
            "field_key",
            F.col("new_text").alias("text"),
            "bbox",
            F.lit(1).alias("page_no"),
            "confidence",
            "reason",
        )

    @cached_property
    def moved(self) -> DataFrame:
        """Moves with the box before and after. A fragment's next move starts where the last one
        ended: moves are numbered per fragment and each looks up its predecessor by number."""
        keys = ["run_id", "frag_ord"]
        numbered = split_row_number(
            self._moves,
            keys,
            [F.col("patch_ord").asc()],
            name="move_no",
            bucket=F.floor(F.col("patch_ord") / ORD_BUCKET),
        )
        earlier = numbered.select(
            *keys, (F.col("move_no") + 1).alias("move_no"), F.col("bbox").alias("__prev")
        )
        origin = self._base.select(*keys, F.col("bbox").alias("__origin"))
        return (
            numbered.join(earlier, [*keys, "move_no"], "left")
            .join(origin, keys, "left")
            .select(
                *keys,
                "patch_ord",
                "move_no",
                "fragment_id",
                F.when(F.col("move_no") > 1, F.col("__prev"))
                .otherwise(F.col("__origin"))
                .alias("before"),
                F.col("bbox").alias("after"),
                "confidence",
                "reason",
            )
        )

    @cached_property
    def assignments(self) -> DataFrame:
        """Fragment of each field: the last assignment or addition that names the field."""
        columns = ["run_id", "patch_ord", "field_key", "fragment_id", "confidence", "reason"]
        rows = self._applied("assign").select(*columns).unionByName(
            self.added.filter("field_key IS NOT NULL AND field_key <> ''").select(*columns)
        )
        if self._prior is not None:
            before = self._prior.withColumn("patch_ord", F.lit(-1).cast("long"))
            rows = rows.unionByName(before.select(*columns))
        value = F.struct("fragment_id", "confidence", "reason", "patch_ord")
        return (
            rows.groupBy("run_id", "field_key")
            .agg(F.max_by(value, "patch_ord").alias("a"))
            .select("run_id", "field_key", "a.*")
        )

    @cached_property
    def fragments(self) -> DataFrame:
        """Fragments after the pass, in the columns they came in: moved boxes in place, additions
        after the last position. Of the moves of a fragment only the last one counts here."""
        keys = ["run_id", "frag_ord"]
        gone = self._quarantined.withColumn("__gone", F.lit(True))
        marks = self._moves.select(*keys, "patch_ord", "bbox").unionByName(gone, allowMissingColumns=True)
        # By key before the grouping, so that no task gets all fragments of a run.
        marks = marks.repartition(*keys).groupBy(*keys).agg(
            F.max_by("bbox", "patch_ord").alias("__after"), F.max("__gone").alias("__gone")
        )
        kept = (
            self._base.join(marks, keys, "left")
            .filter("__gone IS NULL")
            .withColumn("bbox", F.coalesce("__after", "bbox"))
        )
        sizes = self._base.groupBy("run_id").agg((F.max("frag_ord") + 1).alias("__n"))
        fresh = self._numbered_adds(lambda totals: totals.join(sizes, "run_id", "left")).select(
            "run_id",
            (F.coalesce("__n", F.lit(0)) + F.col("add_no") - 1).alias("frag_ord"),
            F.col("fragment_id").alias("self_ref"),
            F.col("new_text").alias("text"),
            "bbox",
            F.lit(1).alias("page_no"),
            F.lit("vlm").alias("source"),
            "confidence",
        )
        columns = self._base.columns
        fresh = fresh.select(*[c for c in fresh.columns if c in columns])
        return kept.select(*columns).unionByName(fresh, allowMissingColumns=True)

    @cached_property
    def visible(self) -> DataFrame:
        """The given fragments without those that this pass rejects; none of quarantined runs."""
        hidden = self.rejected.select("run_id", "frag_ord").unionByName(self._quarantined)
        return visible_fragments(self._base, hidden.repartition("run_id", "frag_ord"))

    @cached_property
    def runs(self) -> DataFrame:
        """The runs with ``n_refined`` counting the additions of this pass, for the next one."""
        counts = self._applied("add").groupBy("run_id").agg(F.count("*").alias("__added"))
        total = F.coalesce(F.col("n_refined").cast("long"), F.lit(0)) + F.coalesce("__added", F.lit(0))
        return self._given.join(counts, "run_id", "left").withColumn("n_refined", total).drop("__added")

    def trail(self) -> dict[str, DataFrame]:
        """The audit tables of this pass and all before it, with ``pass_no`` from 0."""
        out = {}
        for name in AUDITS:
            own, before = getattr(self, name), self._prior_trail.get(name)
            if before is None:
                out[name] = own.withColumn("pass_no", F.lit(0))
                continue
            passes = before.groupBy("run_id").agg((F.max("pass_no") + 1).alias("__pass"))
            numbered = own.join(passes, "run_id", "left").withColumn("pass_no", F.coalesce("__pass", F.lit(0)))
            out[name] = before.unionByName(numbered.drop("__pass"), allowMissingColumns=True)
        return out


def visible_fragments(fragments: DataFrame, rejected: DataFrame) -> DataFrame:
    """Fragments of the rendered text layer: rejected ones stay stored but are not shown."""
    return fragments.join(
        rejected.select("run_id", "frag_ord").distinct(), ["run_id", "frag_ord"], "left_anti"
    )


# ---- traces, usage, statistics ---------------------------------------------------------------

TRACE_FIELDS = ["visual_audit", "scaffold_match", "discrepancies"]


def coerce_trace(trace: Column) -> Column:
    """Trace VARIANT to a struct of text; objects and lists become compact JSON."""

    def text(name: str) -> Column:
        value = F.try_variant_get(trace, f"$.{name}", "variant")
        shape = kind(value)
        plain = F.try_variant_get(value, "$", "string")
        return (
            F.when(shape.isin("object", "array"), F.to_json(value))
            .when(shape == "boolean", F.initcap(plain))
            .when((shape == "null") & value.isNotNull(), F.lit("None"))
            .otherwise(plain)
            .alias(name)
        )

    return F.struct(*[text(n) for n in TRACE_FIELDS])


def token_usage(history: Column) -> Column:
    """Token counts of the last model call in a VARIANT call history; null without calls."""
    calls = F.try_variant_get(history, "$", "array<variant>")
    last = F.try_element_at(calls, F.lit(-1))
    counts = F.struct(
        *[
            F.try_variant_get(last, f"$.usage.{n}", "long").alias(n)
            for n in ("prompt_tokens", "completion_tokens", "total_tokens")
        ]
    )
    return F.when(F.size(calls) > 0, counts)


def refinement_stats(refinements: DataFrame, outcomes: DataFrame, rollup: bool = False) -> DataFrame:
    """Quality and usage per (vlm_model, prompt_version).

    ``refinements``: run_id, vlm_model, prompt_version, total_tokens, duration_ms.
    ``outcomes``: run_id, op, outcome, confidence. Patches are reduced to one row per run before
    they meet the run's model. With ``rollup`` subtotals per model and a grand total are added.
    """
    per_run = outcomes.groupBy("run_id").agg(
        *[F.count_if(F.col("op") == op).alias(f"n_{op}") for op in PATCH_OPS],
        F.count("*").alias("n_patches"),
        F.count_if(F.col("outcome") == "low").alias("n_low"),
        F.count_if(F.col("outcome") == "orphan").alias("n_orphan"),
        F.sum("confidence").alias("sum_confidence"),
    )
    joined = refinements.join(per_run, "run_id", "left")
    keys = ["vlm_model", "prompt_version"]
    grouped = joined.rollup(*keys) if rollup else joined.groupBy(*keys)
    counts = [*[f"n_{op}" for op in PATCH_OPS], "n_patches", "n_low", "n_orphan"]
    out = grouped.agg(
        F.count("*").alias("n_runs"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts],
        F.sum("sum_confidence").alias("sum_confidence"),
        F.sum("total_tokens").alias("total_tokens"),
        F.sum("duration_ms").alias("duration_ms"),
    )
    share = F.nullif(F.col("n_patches"), F.lit(0))
    return out.select(
        *keys,
        "n_runs",
        *counts,
        (F.col("sum_confidence") / share).alias("mean_confidence"),
        (F.col("n_low") / share).alias("low_rate"),
        (F.col("n_orphan") / share).alias("orphan_rate"),
        "total_tokens",
        "duration_ms",
    )

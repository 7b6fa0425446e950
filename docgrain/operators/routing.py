"""Document types, prompt routing, model batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null
from ..functions.values import kind
from ..schemas import DOC_TYPES, KEYWORDS, MAX_IMAGES, VISION_PREFIX
from .ranking import split_row_number

PAGE_BUCKET = 100_000  # pages of one document that one task numbers


def keyword_count(text: Column, words: list[str]) -> Column:
    """How many of the words occur in the (lower-cased) text."""
    hits = [F.contains(text, F.lit(w)).cast("int") for w in words]
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return total


def detect_types(
    df: DataFrame, text: str, keywords: dict[str, list[str]] = KEYWORDS
) -> DataFrame:
    """Add ``detected_types`` (best first) and ``is_mixed``.

    Substring counts over keyword lists; an invoice needs an invoice word and a tax-id word and
    scores both; no hit at all is a delivery order. Equal scores keep the order delivery order,
    invoice, weighing bill.
    """
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    counts = {name: keyword_count(lowered, words) for name, words in keywords.items()}
    prepared = df.select("*", *[n.alias(f"__k_{name}") for name, n in counts.items()])
    order, tax, inv, weigh = (
        F.col(f"__k_{n}") for n in ("delivery_order", "tax_id", "invoice", "weighing_bill")
    )
    invoice_score = F.when((inv > 0) & (tax > 0), inv + tax).otherwise(F.lit(0))

    def scored(score: Column, rank: int, name: str) -> Column:
        return F.struct((-score).alias("s"), F.lit(rank).alias("r"), F.lit(name).alias("t"))

    ranked = F.array_sort(
        F.filter(
            F.array(
                scored(order, 0, "delivery_order"),
                scored(invoice_score, 1, "invoice"),
                scored(weigh, 2, "weighing_bill"),
            ),
            lambda x: x["s"] < 0,
        )
    )
    types = F.transform(ranked, lambda x: x["t"])
    default = F.array(F.lit("delivery_order"))
    return (
        prepared.withColumn("detected_types", types)
        .withColumn("is_mixed", F.size("detected_types") > 1)
        .withColumn(
            "detected_types",
            F.when(F.size("detected_types") > 0, F.col("detected_types")).otherwise(default),
        )
        .drop(*[f"__k_{name}" for name in keywords])
    )


def resolve_doc_type(override: Column, detected: Column) -> tuple[Column, Column]:
    """(doc_type, reject_reason): a known override, else the detected type."""
    label = blank_to_null(override)
    unknown = label.isNotNull() & ~label.isin(DOC_TYPES)
    return (
        F.when(~unknown, F.coalesce(label, detected)),
        F.when(unknown, F.concat(F.lit("unknown doc_type "), label)),
    )


def route_schema(docs: DataFrame, prompts: dict[str, str]) -> DataFrame:
    """Add the prompt of each document's type. Four entries, so a literal map and no join."""
    table = F.create_map(*[F.lit(x) for pair in prompts.items() for x in pair])
    return docs.withColumn("prompt", F.try_element_at(table, F.col("doc_type")))


def build_requests(
    docs: DataFrame, pages: DataFrame, model: str, cap: int = MAX_IMAGES
) -> DataFrame:
    """Model requests: prompt, text and page images, at most ``cap`` to a request.

    ``docs``: document_id, doc_type, prompt, text. ``pages``: document_id, page_no, blob_key.
    Images go along only for vision models, in page order; a document of more pages gives
    further requests, numbered by ``request_no``, so that every page is in exactly one. Pages are
    numbered in buckets, so a very long document is not one task, and only ``cap`` of them meet in a row.
    """
    counts = pages.groupBy("document_id").agg(F.count("*").alias("n_pages"))
    requests = docs.join(counts, "document_id", "left").withColumn(
        "n_pages", F.coalesce("n_pages", F.lit(0))
    )
    if not model.startswith(VISION_PREFIX):
        return requests.withColumn("request_no", F.lit(0)).withColumn(
            "images", F.array().cast("array<string>")
        )
    numbered = split_row_number(
        pages.filter("document_id IS NOT NULL"),
        ["document_id"],
        [F.col("page_no").asc()],
        name="__rn",
        bucket=F.coalesce(F.floor(F.col("page_no") / PAGE_BUCKET), F.lit(-1)),
    )
    chunk = F.expr(f"cast((__rn - 1) div {cap} as int)")
    images = numbered.groupBy("document_id", chunk.alias("request_no")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("page_no", "blob_key"))), lambda p: p["blob_key"]
        ).alias("images")
    )
    return requests.join(images, "document_id", "left").select(
        *requests.columns,
        F.coalesce("request_no", F.lit(0)).alias("request_no"),
        F.coalesce("images", F.array().cast("array<string>")).alias("images"),
    )


Client = Callable[[pd.DataFrame], "pd.Series"]


def run_model_batch(
    requests: DataFrame, open_client: Callable[[], Client], name: str = "answer"
) -> DataFrame:
    """Add the answer of a model client to each request.

    ``open_client`` runs once per partition and returns a function from a batch of requests to a
    series of JSON answers. The requests of a failing batch are asked
    one by one; those that fail again carry the reason in ``error`` and stop nothing.
    """
    schema = requests.schema.simpleString()[len("struct<") : -1]

    def ask(client: Client, row: pd.DataFrame) -> tuple[str | None, str | None]:
        try:
            return client(row).iloc[0], None
        except Exception as exc:
            return None, f"{type(exc).__name__}: {exc}"

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = open_client()
        for batch in batches:
            try:
                answers, errors = client(batch), None
            except Exception:  # the service is external; its failure is data here
                one_by_one = [ask(client, batch.iloc[i : i + 1]) for i in range(len(batch))]
                answers, errors = ([x[k] for x in one_by_one] for k in (0, 1))
            yield batch.assign(**{name: answers, "error": errors})

    return requests.mapInPandas(call, f"{schema},{name}:string,error:string")


def refine_eligibility(runs: DataFrame, pages: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (extraction_run_id, page_no) with the reason they cannot run, or null.

    ``runs``: extraction_run_id, document_id, scaffold and extracted as VARIANT, n_keys = number of
    filled field keys.
    """
    known = runs.select(
        "extraction_run_id",
        "document_id",
        (kind(F.col("scaffold")) == "object").alias("has_scaffold"),
        "n_keys",
        F.lit(True).alias("has_run"),
    )
    present = pages.select("document_id", "page_no", F.lit(True).alias("has_page"))
    joined = requests.join(known, "extraction_run_id", "left").join(
        present, ["document_id", "page_no"], "left"
    )
    reason = (
        F.when(F.col("has_run").isNull(), "extraction run not found")
        .when(~F.coalesce("has_scaffold", F.lit(False)), "scaffold missing or malformed")
        .when(F.col("has_page").isNull(), "page not found")
        .when(F.coalesce("n_keys", F.lit(0)) == 0, "no field keys to refine")
    )
    return joined.select(*requests.columns, reason.alias("reason"))

"""Table shapes and fixed values."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values: closed vocabularies of the data model -------------------------------
DOC_TYPES = ["delivery_order", "weighing_bill", "invoice", "petrol_bill"]
DOC_STATUSES = ["uploaded", "processing", "extracted", "reviewed", "failed"]
PATCH_OPS = ["assign", "add", "reject", "move"]
PAYLOAD_VERSION = "extraction.v1"
DEFAULT_MIME = "application/pdf"

# ---- fixed values: geometry defaults, in PDF points --------------------------------------
LETTER_PAGE = (612.0, 792.0)
A4_PAGE = (595.44, 842.04)
NORM_SPACE = 1000
CONFIDENCE_FLOOR = 0.5
MAX_IMAGES = 5
VISION_PREFIX = "vision-"
ACCURACY_FLOOR = 0.50
PAGE_SIZES = [10, 20, 50]
DEFAULT_PAGE_SIZE = 20

# ---- fixed values: OCR block type -> item label ------------------------------------------
BLOCK_LABELS = {
    "Text": "text",
    "SectionHeader": "section_header",
    "Table": "table",
    "Picture": "picture",
    "Form": "form",
    "Caption": "caption",
    "Footnote": "footnote",
    "PageHeader": "page_header",
    "PageFooter": "page_footer",
    "ListItem": "list_item",
    "Code": "code",
    "Formula": "formula",
    "Title": "title",
}

# ---- fixed values: entities decoded in block text, in this order -------------------------
ENTITIES = [
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&nbsp;", " "),
]

# ---- fixed values: document-type keywords ------------------------------------------------
KEYWORDS = {
    "delivery_order": ["delivery order", "d/o", "delivered to", "sold to", "delivery date"],
    "tax_id": ["tax identification", "tin", "t.i.n", "identification number"],
    "invoice": ["invoice", "invoice number", "bill to", "amount due", "total amount"],
    "weighing_bill": ["weighing", "tare weight", "gross weight", "net weight", "weighing no"],
}

# ---- fixed values: typed records, one per document type ------------------------------------------------
_TEXT = T.StringType()


def _record(texts: list[str]) -> list[T.StructField]:
    return [T.StructField(name, _TEXT) for name in texts]


def _rows(texts: list[str]) -> T.ArrayType:
    return T.ArrayType(T.StructType(_record(texts)))


RECORDS: dict[str, T.StructType] = {
    "delivery_order": T.StructType(
        _record(
            ["do_issuer_name", "sold_to", "sold_to_address", "delivered_to", "delivered_to_address"]
        )
        + [
            T.StructField(name, T.ArrayType(_TEXT))
            for name in ["do_number", "po_number", "vehicle_number", "date"]
        ]
        + [T.StructField("items", _rows(["description", "quantity", "weight_mt"]))]
        + _record(["total_quantity", "total_weight_mt"])
    ),
    "weighing_bill": T.StructType(
        _record(
            [
                "weighing_no", "contract_no", "vehicle_no", "material_name", "gross_weight",
                "tare_weight", "net_weight", "off_weight", "actual_weight", "gross_time",
                "tare_time", "deliver", "receiver", "fleet_name", "remark",
            ]
        )
    ),
    "invoice": T.StructType(
        _record(
            [
                "invoice_number", "invoice_date", "terms", "bill_to", "bill_to_tin",
                "bill_to_address", "from_company", "from_tin",
            ]
        )
        + [T.StructField("items", _rows(["description", "quantity", "unit_price", "amount"]))]
    ),
    "petrol_bill": T.StructType(
        _record(
            [
                "station_name", "station_address", "plate_number", "fuel_type", "litres",
                "unit_price", "total_amount", "purchase_datetime", "receipt_no",
            ]
        )
    ),
}

# ---- nested shapes ------------------------------------------------------------------------
BLOCK_DDL = (
    "struct<id:string,block_type:string,html:string,markdown:string,page:int,"
    "polygon:array<array<double>>,bbox:array<double>,section_hierarchy:map<string,string>>"
)
OCR_DDL = f"blocks array<{BLOCK_DDL}>, page_info variant, metadata struct<page_count:int>"

PATCH_DDL = (
    "array<struct<op:string,fragment_id:string,field_key:string,"
    "new_bbox:struct<l:double,t:double,r:double,b:double>,box_2d:array<int>,"
    "new_text:string,reason:string,confidence:double>>"
)
PATCH_KEYS = [
    "op", "fragment_id", "field_key", "new_bbox", "box_2d", "new_text", "reason", "confidence",
]

EVAL_CASE_DDL = (
    "dataset string, case string, inputs struct<pdf_path:string>, expected_output string, "
    "metadata struct<source_pdf:string,status:string,notes:string>"
)
EVAL_DATASET_DDL = (
    "name string, evaluators array<struct<name:string,options:map<string,string>>>, "
    "cases array<struct<name:string,inputs:struct<pdf_path:string>,expected_output:string,"
    "metadata:struct<source_pdf:string,status:string,notes:string>>>"
)
TRUTH_DDL = (
    "extraction_run_id long, page_no int, fields map<string,struct<fragment_id:string,"
    "bbox:struct<l:double,t:double,r:double,b:double>>>"
)

# ---- fixed values: the five stored tables ---------------------------------------------------------------
TABLES: dict[str, str] = {
    "document": (
        "document_id string, uploaded_by string, filename string, mime_type string, "
        "size_bytes long, blob_key string, sha256 string, page_count int, doc_type string, "
        "status string, created_at timestamp, updated_at timestamp"
    ),
    "document_page": (
        "document_id string, page_no int, width_px int, height_px int, blob_key string, "
        "rendered_at timestamp"
    ),
    "extraction_run": (
        "extraction_run_id long, document_id string, doc_type string, schema_version string, "
        "llm_model string, checkpoint_id string, duration_ms int, extracted string, "
        "markdown string, scaffold string, chunks string, is_current boolean, "
        "created_at timestamp"
    ),
    "field_review": (
        "field_review_id long, extraction_run_id long, reviewer_id string, field_path string, "
        "original_value string, edited_value string, remark string, created_at timestamp"
    ),
    "refinement_run": (
        "refinement_run_id long, extraction_run_id long, vlm_model string, "
        "prompt_version string, scaffold_in string, scaffold_out string, patches string, "
        "arq_trace string, token_usage string, duration_ms int, is_current boolean, "
        "created_at timestamp"
    ),
}

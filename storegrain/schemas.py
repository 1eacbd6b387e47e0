"""Table schemas, and the rules landed rows must meet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import StructType


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


def struct_of(columns: str) -> StructType:
    return StructType.fromDDL(columns)


ADDRESS = "STRUCT<country STRING, extra VARIANT>"

CUSTOMERS = ddl({
    "id": "BIGINT",
    "email": "STRING",
    "first_name": "STRING",
    "last_name": "STRING",
    "phone": "STRING",
    "company": "STRING",
    "customer_group_id": "BIGINT",
    "registration_ip": "STRING",
    "date_created": "TIMESTAMP",
    "date_modified": "TIMESTAMP",
    "addresses": f"ARRAY<{ADDRESS}>",
    "form_fields": "ARRAY<STRUCT<name STRING, value ARRAY<STRING>>>",
    "extra": "VARIANT",
})

FORM_FIELD_VALUES = ddl({"customer_id": "BIGINT", "name": "STRING", "value": "STRING"})

ORDERS = ddl({
    "id": "BIGINT",
    "customer_id": "BIGINT",
    "email": "STRING",
    "cart_id": "STRING",
    "status": "STRING",
    "date_created": "TIMESTAMP",
    "extra": "VARIANT",
})

ORDER_PRODUCTS = ddl({
    "order_id": "BIGINT",
    "sku": "STRING",
    "name": "STRING",
    "quantity": "INT",
    "price": "DECIMAL(18,4)",
    "extra": "VARIANT",
})

ORDER_FEES = ddl({
    "order_id": "BIGINT",
    "name": "STRING",
    "type": "STRING",
    "amount": "DECIMAL(18,4)",
    "tax": "DECIMAL(18,4)",
    "extra": "VARIANT",
})

CART_ITEMS = "ARRAY<STRUCT<name STRING, quantity INT, sku STRING>>"

REGISTRY_COLUMNS = {"name": "STRING", "type": "STRING", "options": "ARRAY<STRING>"}
FIELD_REGISTRY = ddl(REGISTRY_COLUMNS)

CHANGE_COLUMNS = {
    "customer_id": "BIGINT",
    "name": "STRING",
    "value": "STRING",
    "ts": "TIMESTAMP",
    "seq": "BIGINT",
}
CHANGES = ddl(CHANGE_COLUMNS)

# The field types a registry entry may carry.
FIELD_TYPES = ("string", "boolean", "number", "date")


@dataclass(frozen=True)
class Rule:
    """What a landed row must hold at ``path``.

    ``kind`` is ``string``, ``number``, ``whole`` (a number without fraction that
    fits 64 bits), ``money`` (a number, or text of one, of at most four places),
    ``time``, ``text_or_list``, ``array`` or ``object``.  ``required`` says the key must be there, ``nullable`` that a
    JSON null is fine.  ``items`` are the rules for the elements of an array,
    ``members`` those for the keys of an object.
    """

    path: str
    kind: str
    required: bool = True
    nullable: bool = False
    items: tuple["Rule", ...] = ()
    members: tuple["Rule", ...] = ()


OPTIONAL = {"required": False, "nullable": True}

CUSTOMER_RULES = (
    Rule("id", "whole"),
    Rule("email", "string"),
    Rule("first_name", "string"),
    Rule("last_name", "string"),
    Rule("phone", "string"),
    Rule("addresses", "array", items=(Rule("country", "string"),)),
    Rule(
        "form_fields",
        "array",
        items=(
            Rule("name", "string"),
            Rule("value", "text_or_list", required=False, nullable=True),
        ),
    ),
    Rule("company", "string", **OPTIONAL),
    Rule("customer_group_id", "whole", **OPTIONAL),
    Rule("registration_ip_address", "string", **OPTIONAL),
    Rule("date_created", "time", **OPTIONAL),
    Rule("date_modified", "time", **OPTIONAL),
)

ORDER_RULES = (
    Rule("id", "whole"),
    Rule("customer_id", "whole", **OPTIONAL),
    *(Rule(name, "string", **OPTIONAL) for name in ("email", "cart_id", "status")),
    Rule("date_created", "time", **OPTIONAL),
)

ORDER_PRODUCT_RULES = (
    Rule("order_id", "whole"),
    Rule("sku", "string", **OPTIONAL),
    Rule("name", "string", **OPTIONAL),
    Rule("quantity", "whole", **OPTIONAL),
    Rule("price", "money", **OPTIONAL),
)

ORDER_FEE_RULES = (
    Rule("order_id", "whole"),
    Rule("name", "string", **OPTIONAL),
    Rule("type", "string", **OPTIONAL),
    Rule("amount", "money", **OPTIONAL),
    Rule("tax", "money", **OPTIONAL),
)

CART_RULES = (
    Rule("id", "string"),
    Rule("customer_id", "whole", **OPTIONAL),
    Rule("created_time", "time", **OPTIONAL),
    Rule("updated_time", "time", **OPTIONAL),
    Rule(
        "line_items",
        "object",
        **OPTIONAL,
        members=(
            Rule(
                "physical_items",
                "array",
                **OPTIONAL,
                items=(
                    Rule("name", "string", **OPTIONAL),
                    Rule("quantity", "whole", **OPTIONAL),
                    Rule("sku", "string", **OPTIONAL),
                ),
            ),
        ),
    ),
)

REGISTRY_FILE_RULES = (
    Rule(
        "formFields",
        "array",
        required=False,
        items=(
            Rule("name", "string"),
            Rule("type", "string", required=False),
            Rule("options", "array", required=False),
        ),
    ),
)

FIELD_VALUE_RULES = (
    Rule("name", "string"),
    Rule("value", "string", nullable=True),
    Rule("customer_id", "whole"),
)

# The counts of a page's envelope.
PAGE_COUNTS = ("total", "count", "per_page", "current_page", "total_pages")

PAGE_RULES = (
    Rule("data", "array"),
    Rule(
        "meta",
        "object",
        members=(
            Rule(
                "pagination",
                "object",
                required=False,
                members=tuple(Rule(name, "number") for name in PAGE_COUNTS),
            ),
            Rule(
                "cursor_pagination",
                "object",
                required=False,
                members=(
                    Rule("count", "number"),
                    Rule("per_page", "number"),
                    Rule("end_cursor", "string"),
                    Rule("links", "object", members=(Rule("next", "string", required=False),)),
                ),
            ),
        ),
    ),
)

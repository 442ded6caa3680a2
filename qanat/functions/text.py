"""Text and JSON expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed code of each ledger table in a seed event's id.
SEED_CODES = {"payments": 1, "transactions": 2}
SEED_STEP = 10**12


def json_at(doc: Column, path: str) -> Column:
    """The value at a JSON path as text; malformed JSON gives NULL."""
    return F.get_json_object(doc, path)


def sorted_json(**fields: Column) -> Column:
    """A JSON object whose keys are in alphabetical order; NULL fields are written as null."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def payment_id(aggregate_type: Column, aggregate_id: Column, payload: Column) -> Column:
    """Payment events carry the id as their aggregate; any other event may name one in its payload."""
    return F.when(aggregate_type == "payment", aggregate_id.try_cast("long")).otherwise(
        json_at(payload, "$.payment_id").try_cast("long")
    )


def seed_key(table: str, row_id: Column) -> Column:
    return F.concat(F.lit(f"seed-{table}-"), row_id.cast("string"))


def seed_event_id(table: str, row_id: Column) -> Column:
    """Ids of seed events are negative, table by table, and outbox ids positive."""
    return -(F.lit(SEED_CODES[table] * SEED_STEP) + row_id.cast("long"))


def iban(company_id: Column, account_no: Column, n: Column) -> Column:
    return F.format_string("AE07 0331 0000 %04d %04d 00%d", company_id, account_no, n)


def payment_reference(payment_id_: Column) -> Column:
    return F.concat(F.lit("PAY-"), payment_id_.cast("string"))


def status_text(status: Column, awaiting_from: Column) -> Column:
    names = F.array_join(awaiting_from, " or ")
    waiting = F.when(F.size(awaiting_from) > 0, F.concat(F.lit("Awaiting approval from "), names)).otherwise(
        F.lit("Awaiting approval")
    )
    return F.when(status == "EXECUTED", "Executed").when(status == "REJECTED", "Rejected").otherwise(waiting)


def same_email(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def not_blank(text: Column) -> Column:
    return F.length(F.trim(text)) > 0

"""Hand-made extract files."""

from __future__ import annotations

import csv
from pathlib import Path

from tallymill.schemas import ORDER_EXTRACT_COLUMNS, SALES_EXTRACT_COLUMNS

ORDER_DEFAULTS = {
    "order_date": "1/3/2024", "order_code": "2201-1", "factory_code": "30673.0",
    "factory_name": "North", "product_code": "P1", "product_name": "Gloss", "qc": "5L",
    "order_quantity": "10", "delivered_quantity": "0", "numerical_order": "1",
}
SALES_DEFAULTS = {
    "sales_date": "1/3/2024", "sales_code": "2301-1", "factory_code": "30673.0",
    "factory_name": "North", "salesman": "Ann", "product_code": "P1", "product_name": "Gloss",
    "qc": "5L", "sales_quantity": "10", "order_code": "2201-1-0001",
}


def _write(path: Path, columns: list[str], defaults: dict[str, str], rows: list[dict]) -> str:
    with path.open("w", newline="", encoding="utf-8") as handle:
        writer = csv.writer(handle)
        writer.writerow([f"Column {i}" for i, _ in enumerate(columns)])
        for row in rows:
            values = {**defaults, **row}
            writer.writerow([values.get(c) or "" for c in columns])
    return str(path)


def write_orders(path: Path, *rows: dict) -> str:
    return _write(path, ORDER_EXTRACT_COLUMNS, ORDER_DEFAULTS, list(rows))


def write_sales(path: Path, *rows: dict) -> str:
    return _write(path, SALES_EXTRACT_COLUMNS, SALES_DEFAULTS, list(rows))

"""Columns of the entities, as text at the source and as typed after ingest."""

from __future__ import annotations

#: Column: type after ingest. stores keeps two of its columns.
ENTITIES: dict[str, dict[str, str]] = {
    "transactions": {"transaction_id": "string", "store_id": "int", "payment_method_id": "int", "voucher_id": "double", "user_id": "bigint", "original_amount": "double", "discount_applied": "double", "final_amount": "double", "created_at": "string"},
    "transaction_items": {"transaction_id": "string", "item_id": "int", "quantity": "int", "unit_price": "double", "subtotal": "double", "created_at": "string"},
    "users": {"user_id": "bigint", "gender": "string", "birthdate": "date", "registered_at": "timestamp_ntz"},
    "stores": {"store_id": "int", "store_name": "string"},
    "menu_items": {"item_id": "int", "item_name": "string", "category": "string", "price": "double", "is_seasonal": "string", "available_from": "string", "available_to": "string"},
}
#: Columns whose unreadable or missing value makes the whole row a reject, by entity.
REQUIRED = {"transactions": ("store_id", "payment_method_id"), "transaction_items": ("item_id", "quantity", "unit_price", "subtotal"), "users": ("user_id",), "stores": ("store_id",), "menu_items": ("item_id",)}
#: Columns where an empty value is 0.
ZERO = {"transactions": ("user_id", "original_amount", "discount_applied", "final_amount"), "menu_items": ("price",)}
FACTS = ("transactions", "transaction_items")

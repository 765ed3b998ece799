"""Fixed names of the order data model."""

from __future__ import annotations

# The 24 flat order columns, in output order.
ORDER_COLUMNS = [
    "id", "type", "sourceOrderId", "teamId",
    "lineItem_id", "lineItem_quantity", "lineItem_quantityUnit",
    "lineItem_price_amount", "lineItem_price_currency",
    "volume_value", "volume_unit",
    "SO_REF", "CLASS_CODE", "TRAN_TYPE", "CUSTOMER_PO", "TRUCKLOAD_NO", "LOAD_NO",
    "PAYMENT_TERMS", "Homebase_Name_info", "Loading_Sequence",
    "homebaseId", "locationId", "date", "orderDate",
]

# The keys read from the document's top level and from its nested objects.
TOP_KEYS = ["id", "type", "sourceOrderId", "teamId", "homebaseId", "locationId", "date", "orderDate"]
ITEM_KEYS = ["id", "quantity", "quantityUnit"]
PRICE_KEYS = ["amount", "currency"]
VOLUME_KEYS = ["value", "unit"]
CUSTOM_KEYS = [
    "SO_REF", "CLASS_CODE", "TRAN_TYPE", "CUSTOMER_PO", "TRUCKLOAD_NO", "LOAD_NO",
    "PAYMENT_TERMS", "Homebase_Name_info", "Loading_Sequence",
]

# The 25th value of a flat row has no header in the source format; it gets this name here.
RECEIVED_AT_LOCAL = "received_at_local"

# Landed order documents: one JSON line per received body, stamped by whoever received it.
LANDED_ORDER = "received_at timestamp_ntz, seq long, body string"

# Landed pages of a remote table: one JSON line per answer.
LANDED_PAGE = "page_no long, status int, body string"

# Quarantine reasons.
MALFORMED = "malformed"
NULL_OBJECT = "null_object"
EMPTY_LINE_ITEMS = "empty_line_items"

# Outcome statuses and messages.
SUCCESS = "success"
FAILED = "failed"
MSG_UPLOADED = "Upload successful"
MSG_DUPLICATE = "Duplicated OE received. Upload denied."
MSG_FAILED = "Upload failed"
MSG_DUPLICATE_LOG = "Duplicated OE received"

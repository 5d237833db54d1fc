"""One description of CSV text (RFC 4180) for reading, writing and columns."""

from __future__ import annotations

#: Cells are quoted with double quotes, a quote inside is doubled, and edge
#: spaces belong to the cell.
CSV_TEXT = {"sep": ",", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false",
            "ignoreTrailingWhiteSpace": "false", "nullValue": "", "emptyValue": ""}

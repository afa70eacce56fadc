"""Schemas of the records that the engine exchanges."""

from __future__ import annotations

#: The header of a chunk file.
META_DDL = "source string, source_id string, type string, title string, chunk_index int, line_start int, line_end int, char_start int, char_end int, id string, tags array<string>"

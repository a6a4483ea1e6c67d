"""Schemas of the relations that describe a document's pages."""

from __future__ import annotations

PAGE = "doc_id long, page_no int"
GLYPH = f"{PAGE}, seq long, s string, font string, font_size double, x double, y double, w double, h double, rotation double, enc_source string"
RECT = f"{PAGE}, seq long, min_x double, min_y double, max_x double, max_y double"
STROKE = f"{PAGE}, seq long, x0 double, y0 double, x1 double, y1 double"
#: A word, with its band (top to bottom), its place in the band, and the line, column and block it belongs to.
WORD = f"{PAGE}, band_no int, word_no int, line_no int, column_no int, block_no int, s string, x double, y double, w double, h double, font string, font_size double"
LINE = f"{PAGE}, line_no int, column_no int, block_no int, s string, x double, y double, w double, h double, font string, font_size double, n_words long"
BLOCK = f"{PAGE}, block_no int, column_no int, s string, x double, y double, w double, h double, font string, font_size double, n_lines long"
WARNING = f"{PAGE}, code string, message string, detail string"
EDGE = f"{PAGE}, orient string, at double, lo double, hi double"
CELL = f"{PAGE}, table_no int, cell_no int, x0 double, top double, x1 double, bottom double"

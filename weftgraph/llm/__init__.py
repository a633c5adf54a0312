"""Operators for preparing training text: mixing, token counts, deduplication, archives, chat
formatting, quality rules, licence scans, decontamination and token output. Nothing else in the
library imports this subpackage."""

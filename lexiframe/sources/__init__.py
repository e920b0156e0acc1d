from .files import (require_columns, read_sentences_csv, read_text_lines, lines_to_sentences, inline_sentences,
                    read_trainer_log, read_history_csv, write_csv, write_jsonl, write_html)
from . import tables

__all__ = ["require_columns", "read_sentences_csv", "read_text_lines", "lines_to_sentences", "inline_sentences",
           "read_trainer_log", "read_history_csv", "write_csv", "write_jsonl", "write_html", "tables"]

from .text import (split_labels, word_count, words, strip_ws, split_lines, strip_subword_prefix,
                   html_escape, contains_text, letter_count)
from .vectors import softmax, argmax, decode_label, vector_columns, label_code_names
from . import fixed

__all__ = ["split_labels", "word_count", "words", "strip_ws", "split_lines", "strip_subword_prefix",
           "html_escape", "contains_text", "letter_count", "softmax", "argmax", "decode_label",
           "vector_columns", "label_code_names", "fixed"]

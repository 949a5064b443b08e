"""Column expressions over machine-readable zones: alphabet, codec, dates, validation, k-best readings, geometry."""

from zonalis.functions.alphabet import ALPHABET, LENGTH, blind_class, char_value, is_mrz_char, is_mrz_text, is_protected, is_state, iso_states, known_states
from zonalis.functions.kbest import best_of, confidence, greedy, k_best, k_best_texts, log_softmax, text_of
from zonalis.functions.validate import issues, line1_issues, line2_issues, trust

__all__ = ["ALPHABET", "LENGTH", "best_of", "blind_class", "char_value", "confidence", "greedy", "is_mrz_char", "is_mrz_text", "is_protected", "is_state", "iso_states", "issues", "k_best", "k_best_texts", "known_states", "line1_issues", "line2_issues", "log_softmax", "text_of", "trust"]

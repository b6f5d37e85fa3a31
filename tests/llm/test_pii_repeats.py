"""Repeated numbers without a base span or a bracket in the text."""
from ledgermill.llm import pii


def test_repeats_without_base_spans_or_brackets():
    number = "743-555-38-24"
    text = ("some words between " * 8).join([number + " "] * 8)
    base, added = pii.spans_of(text)
    assert base == [] and len(added) == 8 and {text[s:e] for _, s, e in added} == {number}
    assert number not in pii.mask(text)
    assert added == pii.spans_of(text + "(x)")[1]
    assert pii.spans_of(f"once {number} only") == ([], [])

"""Finding and masking sensitive content in tables of documents, on Spark."""

from kuronuri.operators.dictionary import DictMatcher, company_matcher, keyword_matcher
from kuronuri.operators.overrides import Overrides
from kuronuri.plans.masking import mask
from kuronuri.policy import Policy, load_policy

__all__ = [
    "DictMatcher", "Overrides", "Policy", "company_matcher", "keyword_matcher", "load_policy",
    "mask",
]

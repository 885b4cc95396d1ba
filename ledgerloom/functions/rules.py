"""Row rules: each is a condition that must hold and the text shown when it does not."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted codes and the account number format.
CURRENCIES = ("USD", "EUR", "GBP", "JPY")
TRANSACTION_TYPES = ("debit", "credit")
STATUSES = ("completed", "pending", "failed")
REQUIRED_TEXT = (
    "transaction_id",
    "currency",
    "merchant_name",
    "category",
    "account_id",
    "transaction_type",
    "status",
)
# Whole-string match with any decimal digit; `$` and `\d` are narrower or wider in Java.
ACCOUNT_PATTERN = r"\AACC-\p{Nd}{5}\z"


@dataclass(frozen=True)
class Rule:
    message: str
    passes: Column

    def failure(self) -> Column:
        """The message where the rule fails, NULL where it passes or is unknown."""
        return F.when(~self.passes, F.lit(self.message))


# The texts of the rules, which quarantined records carry.
def filled(name: str) -> Rule:
    return Rule(
        f"{name} is null or empty",
        F.col(name).isNotNull() & (F.octet_length(name) > 0),
    )


def one_of(name: str, accepted: Sequence[str]) -> Rule:
    return Rule(f"{name} not in allowed values", F.col(name).isin(*accepted))


def transaction_rules() -> list[Rule]:
    """The thirteen rules of a transaction record, in reporting order."""
    return [
        *(filled(name) for name in REQUIRED_TEXT),
        Rule("timestamp is null", F.col("timestamp").isNotNull()),
        Rule(
            "amount is null or not positive",
            F.col("amount").isNotNull() & (F.col("amount") > 0),
        ),
        one_of("currency", CURRENCIES),
        one_of("transaction_type", TRANSACTION_TYPES),
        one_of("status", STATUSES),
        Rule(
            "account_id does not match ACC-XXXXX pattern",
            F.col("account_id").rlike(ACCOUNT_PATTERN),
        ),
    ]


def all_pass(rules: Sequence[Rule]) -> Column:
    """True only where every rule holds; an unknown outcome counts as a failure."""
    return F.coalesce(reduce(and_, (rule.passes for rule in rules)), F.lit(False))


def rejection_text(rules: Sequence[Rule]) -> Column:
    """One slot per rule joined by ``"; "``; a passing rule leaves its slot empty."""
    return F.concat_ws("; ", *(F.coalesce(rule.failure(), F.lit("")) for rule in rules))


def rejection_list(rules: Sequence[Rule]) -> Column:
    """Only the messages of failing rules, in rule order."""
    return F.array_compact(F.array(*(rule.failure() for rule in rules)))

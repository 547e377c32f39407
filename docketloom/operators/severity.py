"""Severity of a checked citation: four axes, each an ordered list of rules, and the card's tier.

A rule is (condition, status, tier); the first whose condition holds decides. Tiers run from 1 (critical) to 5 (pass); a null
tier takes no part. Conditions on three-valued flags ask for TRUE or FALSE by name, so NULL never fires.

Columns of a card: opinion_resolved, lookup_status, no_results, outside_coverage, finding (of a manual check), override, name_cite_ok,
docket_source, reporter_style, pincite_given, pincite_found, unpaginated, quote_marks, quotes (array of result, confirmed, licensed,
alterations_only, clean, brackets, ellipses), proposition, adverse, quote_matched, supports, score, inextractability, opinion_chars,
application, treatment, nested, url.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import by_row

from .grade import THIN, is_false, is_true

CRITICAL, UNVERIFIED, DEFECT, REVIEW, PASS = 1, 2, 3, 4, 5
AXES = ("identity", "quote", "support", "treatment")
Rule = tuple[Column, str, int | None]


def decide(rules: list[Rule], status: str, tier: int | None) -> Column:
    """(status, tier) of the first rule that holds, else the given ones."""
    row = lambda s, t: F.struct(F.lit(s).alias("status"), F.lit(t).cast("int").alias("tier"))
    out = F
    for when, s, t in rules:
        out = out.when(when, row(s, t))
    return out.otherwise(row(status, tier))


def found(kind: str) -> Column:
    return F.coalesce(F.col("finding") == kind, F.lit(False))


def missing_address() -> Column:
    return F.coalesce(F.col("lookup_status") == 404, F.lit(False))


def wrong_document() -> Column:
    return found("confirmed_wrong_case")


def identity_unconfirmed() -> Column:
    """Resolved, but the identity gate said no and nobody has looked."""
    return is_true("opinion_resolved") & is_false("name_cite_ok") & ~wrong_document() & ~is_true("override")


def docket_for_reporter() -> Column:
    """A reporter cite that resolved to a docket record without its address or page."""
    return is_true("opinion_resolved") & is_true("docket_source") & is_true("reporter_style") & (missing_address() | is_false("pincite_found"))


def identity() -> Column:
    lost, empty = ~is_true("opinion_resolved"), missing_address() & is_true("no_results")
    return decide(
        [
            (lost & empty & is_true("outside_coverage"), "outside_coverage", UNVERIFIED),
            (lost & empty, "possible_nonexistent", UNVERIFIED),
            (lost, "not_found", None),
            (wrong_document() & missing_address(), "wrong_doc_coverage", UNVERIFIED),
            (wrong_document(), "wrong_case", CRITICAL),
            (docket_for_reporter(), "wrong_doc_coverage", UNVERIFIED),
            (is_false("name_cite_ok"), "unconfirmed", UNVERIFIED),
        ],
        "confirmed",
        PASS,
    )


def any_quote(test) -> Column:
    return F.coalesce(F.exists("quotes", test), F.lit(False))


def quote() -> Column:
    has = F.coalesce(F.size("quotes") > 0, F.lit(False))
    marks, lost = is_true("quote_marks"), ~is_true("opinion_resolved")
    yes = lambda c: F.coalesce(c, F.lit(False))
    absent = lambda confirmed: any_quote(lambda q: (q["result"] == "FABRICATED") & (yes(q["confirmed"]) == confirmed))
    first = F.try_element_at(F.filter("quotes", lambda q: q["result"] == "CLOSE"), F.lit(1))
    by_marks = yes(first["clean"]) & (first["brackets"] + first["ellipses"] > 0)
    elsewhere = identity_unconfirmed() | wrong_document() | docket_for_reporter()
    return decide(
        [
            (lost & (has | marks), "unchecked", None),
            (lost, "no_quote", None),
            (is_true("override") & found("confirmed_supports"), "verified_agent", PASS),
            (~has & marks, "present_unlocated", REVIEW),
            (~has, "no_quote", None),
            (elsewhere & any_quote(lambda q: q["result"].isin("FABRICATED", "CLOSE")), "unchecked_identity", None),
            (absent(True), "fabricated", CRITICAL),
            (absent(False) & is_true("override"), "verified_agent", PASS),
            (absent(False), "unconfirmed_absence", REVIEW),
            (first.isNotNull() & by_marks, "verify_brackets", REVIEW),
            (first.isNotNull(), "misquote", DEFECT),
            (any_quote(lambda q: yes(q["licensed"])), "verified_licensed", PASS),
            (any_quote(lambda q: yes(q["alterations_only"])), "verified_alterations", PASS),
        ],
        "verified",
        PASS,
    )


def support() -> Column:
    matched, chars = is_true("quote_matched"), F.col("opinion_chars")
    thin = (chars > 0) & (chars < THIN)
    score, against = F.col("score"), F.col("inextractability")
    fabricated = any_quote(lambda q: (q["result"] == "FABRICATED") & F.coalesce(q["confirmed"], F.lit(False)))
    return decide(
        [
            (~is_true("opinion_resolved"), "unable", UNVERIFIED),
            (F.coalesce(F.trim("proposition"), F.lit("")) == "", "no_proposition", REVIEW),
            (identity_unconfirmed(), "identity_unconfirmed", UNVERIFIED),
            (docket_for_reporter(), "wrong_document_recap", UNVERIFIED),
            (wrong_document(), "wrong_document", UNVERIFIED),
            (fabricated & ~is_true("override"), "superseded", None),
            (found("confirmed_contrary"), "contrary", CRITICAL),
            (is_true("override"), "supported", PASS),
            (is_true("adverse") & ~matched & ~(is_true("supports") & (score >= 0.8)), "adverse_by_design", PASS),
            (is_true("pincite_given") & is_false("pincite_found") & ~is_true("unpaginated") & ~matched, "page_not_found", REVIEW),
            (F.coalesce(F.col("application") == "distinguish", F.lit(False)), "cited_to_distinguish", REVIEW),
            (F.coalesce(F.col("application") == "applied_rule", F.lit(False)), "applied_rule", REVIEW),
            ((against >= 0.7) & ~matched, "does_not_support", DEFECT),
            (matched & ~thin, "supported", PASS),
            (thin, "review", REVIEW),
            (~is_true("supports") & (score == 0) & (against == 0), "text_unavailable", UNVERIFIED),
            ((against >= 0.5) | (score < 0.3), "review", REVIEW),
            (is_true("supports") & (score >= 0.8), "supported", PASS),
            (is_true("supports") & (score > 0.5), "somewhat", REVIEW),
        ],
        "review",
        REVIEW,
    )


def treatment() -> Column:
    t = F.coalesce(F.col("treatment"), F.lit("not_checked"))
    return decide([(t == "not_checked", "not_checked", None), (t == "negative", "negative", REVIEW), (t == "caution", "caution", REVIEW)], "clean", PASS)


def card() -> list[Column]:
    """identity, quote, support and treatment as (status, tier) structs."""
    return [f().alias(a) for a, f in zip(AXES, (identity, quote, support, treatment), strict=True)]


def card_tier() -> Column:
    """Over the four axes: the least tier, 5 without any; a nested citation only informs, or asks for review when nothing was found for it."""
    least = F.coalesce(F.least(*(F.col(f"{a}.tier") for a in AXES)), F.lit(PASS))
    reached = is_true("opinion_resolved") | (F.coalesce("url", F.lit("")) != "")
    return F.when(is_true("nested"), F.when(reached, PASS).otherwise(REVIEW)).otherwise(least)


def worst_status() -> Column:
    """The status of the first axis, in their order, with the least tier; null when all pass."""
    rows = F.array(*(F.struct(F.col(f"{a}.tier").alias("tier"), F.lit(i).alias("at"), F.col(f"{a}.status").alias("status")) for i, a in enumerate(AXES)))
    worst = F.array_min(F.filter(rows, lambda r: r["tier"].isNotNull()))
    return F.when(worst["tier"] < PASS, worst["status"])


def all_clean(tier: Column) -> Column:
    return (tier == PASS) & F.forall(F.array(*(F.col(f"{a}.tier") for a in AXES)), lambda t: t.isNull() | (t == PASS))


def bracket_flags(text: str) -> list[bool]:
    out, depth = [], 0
    for w in re.split(r"[ \t\n\x0b\f\r]+", text):
        if w:
            opened, closed = w.count("["), w.count("]")
            out.append(depth > 0 or opened > 0 or closed > 0)
            depth = max(0, depth + opened - closed)
    return out


def in_brackets(text: Column) -> Column:
    """For each word whether it stands inside square brackets or has one, by a running depth that never falls under 0."""
    return by_row(bracket_flags, "array<boolean>", text)


def high_risk() -> Column:
    """Reasons why a resolution may be wrong. Over: cite_text, opinion_source, search_detail, pincite_note, name_cite_ok, cite_contradicted, address_mismatch."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    source = F.trim(low("opinion_source"))
    note = low("pincite_note")
    reasons = [
        (F.coalesce(F.col("cite_text").rlike(r"\[U\]|\(U\)"), F.lit(False)), "unpublished slip opinion"),
        ((source != "") & (source != "courtlistener"), "free source"),
        (F.contains(low("search_detail"), F.lit("patched from free source via gap manifest")), "patched"),
        (F.contains(note, F.lit("non-reporter copy")) | F.contains(note, F.lit("no reporter pagination")), "non-reporter copy"),
        (is_false("name_cite_ok"), "identity gate failed"),
        (is_true("cite_contradicted"), "address contradicted"),
        (is_true("address_mismatch"), "address mismatch"),
    ]
    return F.filter(F.array(*(F.when(c, r) for c, r in reasons)), lambda r: r.isNotNull())


SOMEWHAT_CONFIDENCE = 0.35
ADVERSE = ("does_not_support", "cited_as_contrary", "identity_unconfirmed", "pincite_not_found")


def must_verify(verdict: Column, risks: Column) -> Column:
    """Why a card must be checked by hand, or null. Over ``quotes``, ``lookup_status`` and ``score`` besides."""
    absent = lambda confirmed: any_quote(lambda q: (q["result"] == "FABRICATED") & (F.coalesce(q["confirmed"], F.lit(False)) == confirmed))
    risky = F.size(risks) > 0
    address = F.coalesce(F.col("lookup_status") == 200, F.lit(False))
    return (
        F.when(verdict == "does_not_support", "contrary or unsupportive")
        .when(absent(False), "unconfirmed fabricated quotation")
        .when(absent(True) & ~address, "fabricated quotation without an address match")
        .when(verdict.isin(*ADVERSE) & risky, "adverse verdict")
        .when((verdict == "somewhat") & (F.col("score") < SOMEWHAT_CONFIDENCE) & risky, "low confidence")
    )

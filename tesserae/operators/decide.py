"""Ordered decision cascades as single Column expressions: event resolution, lineage, materiality, confidence, strength.

Each gives a struct with the decision and the rule that made it, so that every outcome can be explained; all rules of a
row are evaluated in one projection. Names of paths and reasons are fixed values, listed in functions.fixed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.numeric import clamp


def first_rule(rules: list[tuple[Column, Column]], other: Column) -> Column:
    out = None
    for when, value in rules:
        out = F.when(when, value) if out is None else out.when(when, value)
    return out.otherwise(other) if out is not None else other


def _verdict(action: str, path: str) -> Column:
    return F.struct(F.lit(action).alias("action"), F.lit(path).alias("path"))


def resolve(f: dict[str, Column]) -> Column:
    """merge, split or ambiguous for an incoming story and a candidate event.

    f: in_window, s (title similarity), rare, person, bigram, other_language (booleans), shared, core_shared, hub_free_core
    (counts), core_sim, claim_overlap, generic_overlap, cos, number_conflict, number_agreement, anchor, entity_blocked.
    """
    s, cos, clash, blocked = f["s"], F.coalesce(f["cos"], F.lit(0.0)), f["number_conflict"], f["entity_blocked"]
    open_ = ~blocked & ~clash
    core = f["hub_free_core"] > 0
    rules = [
        (~f["in_window"], _verdict("split", "time_window")),
        (s >= 0.55, _verdict("merge", "headline")),
        (f["rare"] & (s >= 0.2), _verdict("merge", "rare_token")),
        (f["person"] & (s >= 0.2), _verdict("merge", "person")),
        ((s >= 0.1) & f["bigram"] & core, _verdict("merge", "bigram_entity")),
        (f["number_agreement"] & (f["core_shared"] >= 2), _verdict("merge", "num_entity")),
        ((s < 0.1) & ~clash & core & (f["shared"] >= 2) & (f["core_sim"] >= 0.4), _verdict("merge", "cross_lingual")),
        (f["claim_overlap"] >= 0.5, _verdict("merge", "distinctive_claim")),
        (open_ & (cos >= 0.87), _verdict("merge", "semantic_strong")),
        (open_ & f["other_language"] & (cos >= 0.78) & (f["shared"] >= 1), _verdict("merge", "semantic_xlang")),
        (open_ & (cos >= 0.72) & f["anchor"], _verdict("merge", "semantic_anchored")),
        (open_ & (cos >= 0.77) & f["bigram"] & (f["core_shared"] >= 1), _verdict("merge", "semantic_facet")),
        (~blocked & (f["core_sim"] >= 0.5) & (f["shared"] >= 2) & ~(clash & ((s < 0.2) | ~core)), _verdict("merge", "entity")),
        (~blocked & (f["generic_overlap"] >= 0.5) & ((f["shared"] >= 1) | (s >= 0.1)), _verdict("merge", "generic_claim")),
        (cos >= 0.72, _verdict("ambiguous", "semantic_ambiguous")),
        (blocked, _verdict("split", "entity_blocked")),
    ]
    return first_rule(rules, _verdict("split", "no_path"))


def blocked(core_a: Column, core_b: Column) -> Column:
    """Both cores name entities and share none."""
    return (F.size(core_a) > 0) & (F.size(core_b) > 0) & ~F.arrays_overlap(core_a, core_b)


def replay(f: dict[str, Column], entities: dict[str, Column]) -> Column:
    """The decision with other entity features in place, against the decision as it was: same, blocked, enabled or indeterminate."""
    before, after = resolve(f)["action"], resolve(f | entities)["action"]
    return F.when((before == "ambiguous") | (after == "ambiguous"), "indeterminate").when(before == after, "same").when(after == "split", "blocked").otherwise("enabled")


def lineage(c: dict[str, Column]) -> Column:
    """relation, rule and confidence of a document against its best senior candidate.

    c: primary, has_candidates, title, summary (similarities of the best eligible parent, null for none), other_source,
    number_conflict, shared_numbers, quotes_primary, named_outlet, dangling, foreign_numbers, disjoint_numbers, best_senior.
    """
    t, m = F.coalesce(c["title"], F.lit(0.0)), F.coalesce(c["summary"], F.lit(0.0))
    near = (t >= 0.55) & ~c["number_conflict"]

    def say(relation: str, rule: str, confidence: Column | float) -> Column:
        score = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
        return F.struct(F.lit(relation).alias("relation"), F.lit(rule).alias("rule"), score.alias("confidence"))

    rules = [
        (c["primary"], say("original", "primary_source", 0.9)),
        (near & (t >= 0.8) & c["other_source"] & ((c["shared_numbers"] >= 1) | (m >= 0.3) | (t >= 0.9)), say("syndicated", "wire_copy", F.least(F.lit(0.95), t + 0.05))),
        (c["quotes_primary"], say("press_release_based", "primary_phrase", 0.85)),
        (c["named_outlet"], say("quoted", "named_outlet", 0.9)),
        (near & ((m >= 0.35) | ((t >= 0.65) & (c["shared_numbers"] >= 1)) | (t >= 0.7)), say("rewritten", "close_text", 0.65)),
        (~c["has_candidates"], say("unknown", "no_evidence", 0.3)),
        (c["dangling"], say("unknown", "dangling_attribution", 0.35)),
        (c["foreign_numbers"], say("unknown", "possible_translation", 0.4)),
        (c["disjoint_numbers"], say("unknown", "conflicting_figures", 0.4)),
        (F.coalesce(c["best_senior"], F.lit(0.0)) >= 0.35, say("unknown", "conflicting_similarity", 0.4)),
    ]
    return first_rule(rules, say("original", "nothing_close", 0.6))


def _level(level: str, why: str) -> Column:
    return F.struct(F.lit(level).alias("level"), F.lit(why).alias("why"))


def macro(baseline: Column, annual: Column, decision_step: Column, daily: Column, revision: Column, core: Column, z: Column, history: Column) -> Column:
    """z counts only from eight earlier changes on."""
    known = F.when(history >= 8, F.coalesce(z, F.lit(0.0))).otherwise(F.lit(0.0))
    return first_rule([
        (baseline | annual, _level("limited", "baseline")), (~daily & (F.coalesce(decision_step, F.lit(0.0)) >= 0.1), _level("major", "decision")),
        (revision & core & (known >= 2), _level("meaningful", "revision")), (revision, _level("limited", "revision")),
        ((known >= 2.5) & core, _level("major", "surprise")), (known >= 2.5, _level("meaningful", "surprise")), ((known >= 1.5) & core, _level("meaningful", "release")),
    ], _level("limited", "release"))


def corporate_action(kind: Column, factor: Column, cash: Column, price: Column, same_basis: Column) -> Column:
    """A split by its factor, a dividend by its yield against a price of the same basis and currency."""
    usable = same_basis & (price > 0)
    return first_rule([
        ((kind == "stock_split") & ((factor >= 5) | (factor <= 0.2)), _level("meaningful", "split")), (kind == "stock_split", _level("limited", "split")),
        (usable & (cash / price >= 0.02), _level("meaningful", "yield")),
    ], _level("limited", "dividend"))


def market(pct: Column, sd: Column, n: Column, index: Column, equity: Column) -> Column:
    z = F.abs(pct / sd)
    blind = (F.coalesce(n, F.lit(0)) < 8) | ~(F.coalesce(sd, F.lit(0.0)) > 0)
    return first_rule([
        (blind & (F.abs(pct) >= F.when(index, 2.0).otherwise(4.0)), _level("limited", "no_volatility")), (blind, _level("none", "no_volatility")), (z >= 4, _level("meaningful", "z")),
        ((z >= 2.5) & (index | ~equity), _level("meaningful", "z")),
    ], _level("limited", "z"))


def evidence_strength(independent: Column, claims: Column, primary: Column, supported: Column, disputed: Column, unresolved: Column) -> Column:
    share = F.when(claims > 0, disputed / claims).otherwise(0.0)
    s = clamp(F.lit(0.3) + F.least(F.lit(1.0), independent / 5) * 0.35 + F.least(F.lit(1.0), claims / 30) * 0.15 + F.least(F.lit(1), primary) * 0.1 + F.least(F.lit(1.0), supported / 5) * 0.15 - share * 0.4)
    return F.when(unresolved > independent, F.least(s, F.lit(0.5))).otherwise(s)


def impact(entity: Column, geography: Column, economy: Column, novelty: Column, coverage: Column) -> Column:
    return entity * 0.2 + geography * 0.2 + economy * 0.1 + novelty * 0.1 + coverage * 0.4


def relevance(matched: Column, topic: Column, instrument: Column, watching: Column) -> Column:
    return F.when(~watching, 0.5).otherwise(F.least(F.lit(1.0), matched * 0.35 + F.when(topic, 0.25).otherwise(0.0) + F.when(instrument, 0.15).otherwise(0.0)))


def prominence(in_title: Column, share: Column, hits: Column, claim_subject: Column) -> Column:
    """subject, actor, mention or none, with a score; a claim's subject gains."""
    base = first_rule([
        (in_title, F.struct(F.lit("subject").alias("role"), F.lit(0.9).alias("p"), F.lit(1.0).alias("most"))), (share >= 0.4, F.struct(F.lit("actor").alias("role"), F.lit(0.7).alias("p"), F.lit(1.0).alias("most"))),
        (hits > 0, F.struct(F.lit("mention").alias("role"), F.least(F.lit(0.35), share + 0.15).alias("p"), F.lit(0.35).alias("most"))),
    ], F.struct(F.lit("none").alias("role"), F.lit(0.15).alias("p"), F.lit(0.3).alias("most")))
    return F.struct(base["role"].alias("role"), F.round(F.least(base["most"], base["p"] + F.when(claim_subject, 0.15).otherwise(0.0)), 6).alias("p"))


def significance(age_hours: Column, n: Column, sources: Column, headline: Column, scoped: Column, domain: Column) -> Column:
    bonus = F.when(domain == "geopolitics", 45).when(domain == "frontier_tech", 40).when(domain == "economy", 35).when(domain == "national_policy", 30).otherwise(0)
    return F.greatest(F.lit(0), 48 - age_hours) + F.least(F.lit(60), n * 15) + (sources - 1) * 35 + F.when(headline, 15).otherwise(0) + F.when(scoped, 10).otherwise(0) + bonus

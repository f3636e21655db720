"""Facts from the web: staged, promoted, scoped, aged and revalidated, with contradictions between claims.

A fact's history is a log of events; `transitions` folds each fact's events in their order, a row at a time, so that a
fact with any number of events needs no memory for them.  The same step serves the stream (streaming/facts.py).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import join_by_share

#: States, tiers from narrow to wide, freshness, and the reasons that records carry.
STATES = ("staged", "trusted")
TIERS = ("local", "workspace", "global")
FRESH, STALE, PENDING = "fresh", "stale", "revalidation_pending"
DEFAULT_TTL_HOURS = 72.0
KEPT_MOVES = 20
#: Events that become Python objects at once.
AT_ONCE = 1000
PROMOTED = {"explicit": "explicit_backend_approval", "evidence": "evidence_count_confidence_source_threshold", "neither": "insufficient_evidence_or_confidence"}
MOVED = {"workspace": "local_to_workspace_threshold", "global": "workspace_to_global_strict_threshold"}
STAGED_REASON, STAGED_AGE, VALIDATED, WITHIN, EXPIRED, NO_BASIS, ASKED = "staged_pending_approval", "staged_not_yet_validated", "approved_and_validated", "within_ttl_window", "ttl_expired", "missing_validation_basis", "stale_requires_revalidation"
#: What promotion asks of a fact.
TRUST_EVIDENCE, TRUST_CONFIDENCE = 2, 0.7
WORKSPACE_EVIDENCE, WORKSPACE_CONFIDENCE = 1, 0.6
GLOBAL_EVIDENCE, GLOBAL_CONFIDENCE = 2, 0.8

EVENT_COLUMNS = ("fact_id", "at", "seq", "op", "evidence", "confidence", "has_source", "approved", "ttl_hours", "state", "tier", "lifecycle", "reason", "conflict")
TRANSITION = "fact_id long, at long, seq long, op string, changed boolean, state string, tier string, lifecycle string, freshness_reason string, validated_at long, asked_at long, approved_at long, approval_reason string, n_moves int, last_move string"


@dataclass
class Fact:
    """A fact as it stands; times are seconds, None where something hasn't happened."""

    created_at: int
    evidence: list[str] = field(default_factory=list)
    confidence: float = 0.0
    has_source: bool = False
    approved: bool = False
    ttl_hours: float | None = None
    policy_hours: float | None = None
    state: str = "staged"
    tier: str = "local"
    lifecycle: str = STALE
    freshness_reason: str = ""
    validated_at: int | None = None
    asked_at: int | None = None
    approved_at: int | None = None
    approval_reason: str = ""
    updated_at: int | None = None
    moves: list[list] = field(default_factory=list)

    def hours(self) -> float:
        """How long a validation holds: the fact's own time, else its policy's, else the default; 0 counts as unset."""
        return self.ttl_hours or self.policy_hours or DEFAULT_TTL_HOURS

    def basis(self) -> int | None:
        known = (self.validated_at, self.approved_at, self.updated_at, self.created_at)
        return next((t for t in known if t is not None), None)

    def expires_at(self) -> int | None:
        """The first second at which a trusted, fresh fact is too old."""
        if self.state != "trusted" or self.lifecycle != FRESH or self.basis() is None:
            return None
        return self.basis() + int(self.hours() * 3600) + 1

    def packed(self) -> str:
        return json.dumps(vars(self))

    def told(self) -> str:
        """All that is known, to be compared."""
        return repr(list(vars(self).values()))

    @classmethod
    def unpacked(cls, text: str) -> Fact:
        return cls(**json.loads(text))


def _written(fact: Fact | None, e: dict, staged: bool) -> Fact:
    """A fact put down as the event says; what was known of it is gone but the time of its making."""
    at = e["at"]
    state = "staged" if staged or e["state"] not in STATES else e["state"]
    life = STALE if staged else (e["lifecycle"] or FRESH)
    life = life if life in (FRESH, STALE, PENDING) else STALE
    return Fact(
        created_at=fact.created_at if fact else at,
        evidence=list(e["evidence"] or ()),
        confidence=float(e["confidence"] or 0.0),
        has_source=bool(e["has_source"]),
        approved=bool(e["approved"]),
        ttl_hours=e["ttl_hours"],
        policy_hours=DEFAULT_TTL_HOURS if staged else None,
        state=state,
        tier="local" if staged or e["tier"] not in TIERS else e["tier"],
        lifecycle=life,
        freshness_reason=STAGED_AGE if staged else (e["reason"] or ""),
        validated_at=at if life == FRESH else None,
        asked_at=at if staged else None,
        approved_at=at if state == "trusted" else None,
        approval_reason=STAGED_REASON if state == "staged" else "",
        updated_at=at,
    )


def _promoted(fact: Fact, e: dict) -> None:
    different = {x.strip() for x in fact.evidence if x and x.strip()}
    by_evidence = len(different) >= TRUST_EVIDENCE and fact.confidence >= TRUST_CONFIDENCE and fact.has_source
    good = fact.approved or by_evidence
    fact.approval_reason = PROMOTED["explicit" if fact.approved else "evidence" if good else "neither"]
    fact.state, fact.lifecycle = ("trusted", FRESH) if good else ("staged", STALE)
    fact.freshness_reason = VALIDATED if good else PROMOTED["neither"]
    fact.approved_at, fact.policy_hours, fact.updated_at = e["at"] if good else None, DEFAULT_TTL_HOURS, e["at"]
    if good:
        fact.validated_at, fact.asked_at = e["at"], None


def _aged(fact: Fact, at: int) -> None:
    if fact.state != "trusted":
        return
    hours, basis = fact.hours(), fact.basis()
    if basis is None:
        life, why = STALE, NO_BASIS
    else:
        life, why = (FRESH, WITHIN) if at - basis <= hours * 3600 else (STALE, EXPIRED)
    if (fact.lifecycle, fact.freshness_reason, fact.policy_hours or DEFAULT_TTL_HOURS) != (life, why, hours):
        fact.lifecycle, fact.freshness_reason, fact.policy_hours, fact.updated_at = life, why, hours, at
        fact.validated_at = fact.validated_at if fact.validated_at is not None else fact.approved_at


def _asked(fact: Fact, e: dict) -> None:
    if fact.asked_at is None:  # the first request stays
        fact.lifecycle, fact.freshness_reason, fact.asked_at, fact.updated_at = PENDING, e["reason"] or ASKED, e["at"], e["at"]


def _moved(fact: Fact, e: dict) -> None:
    """One tier wider, if the fact is ready for it and no open claim contradicts it."""
    to, n = e["op"], len(fact.evidence)
    if fact.tier != TIERS[TIERS.index(to) - 1] or e["conflict"]:
        return
    if to == "workspace":
        ready = fact.confidence >= WORKSPACE_CONFIDENCE and n >= WORKSPACE_EVIDENCE and fact.has_source
    else:
        ready = fact.state == "trusted" and fact.lifecycle == FRESH and fact.confidence >= GLOBAL_CONFIDENCE and n >= GLOBAL_EVIDENCE
    if ready:
        fact.moves = [*fact.moves, [fact.tier, to, e["reason"] or MOVED[to], e["at"]]][-KEPT_MOVES:]
        fact.tier, fact.updated_at = to, e["at"]


def stepped(fact: Fact | None, e: dict) -> Fact | None:
    """A fact after an event: stage, upsert, promote, workspace, global, evaluate or revalidate.  What isn't there yet
    can only be staged or upserted; an unknown event changes nothing."""
    if e["op"] in ("stage", "upsert"):
        return _written(fact, e, e["op"] == "stage")
    if fact is not None:
        if e["op"] == "evaluate":
            _aged(fact, e["at"])
        elif e["op"] in _STEPS:
            _STEPS[e["op"]](fact, e)
    return fact


_STEPS = {"promote": _promoted, "workspace": _moved, "global": _moved, "revalidate": _asked}


def _row(fact_id: int, at: int, seq: int | None, op: str, changed: bool, f: Fact) -> tuple:
    last = f"{f.moves[-1][0]}>{f.moves[-1][1]}" if f.moves else None
    return (fact_id, at, seq, op, changed, f.state, f.tier, f.lifecycle, f.freshness_reason, f.validated_at, f.asked_at, f.approved_at, f.approval_reason, len(f.moves), last)


def expired(fact_id: int, fact: Fact | None, until: int) -> list[tuple]:
    """The row of a fact that has become too old before `until`, which makes it stale."""
    due = fact.expires_at() if fact else None
    if due is None or due > until:
        return []
    _aged(fact, due)
    return [_row(fact_id, due, None, "expire", True, fact)]


def advanced(fact_id: int, fact: Fact | None, e: dict, expire: bool) -> tuple[Fact | None, list[tuple]]:
    """A fact after an event, and the rows that tell of it: first of its ageing until then, if that is watched."""
    out = expired(fact_id, fact, e["at"]) if expire else []
    before = fact.told() if fact else None
    fact = stepped(fact, e)
    if fact is not None:
        out.append(_row(fact_id, e["at"], e["seq"], e["op"], fact.told() != before, fact))
    return fact, out


def transitions(events: DataFrame, expire_until: int | None = None) -> DataFrame:
    """A row for each event of a known fact, with the fact as it stands after it; events: EVENT_COLUMNS.

    Events of a fact go by at (seconds, null first), seq and op; rows without a fact_id belong to no fact and are left
    out, repeated events are events.  With expire_until, a fact that becomes too old before its next event, or before that
    time, gets a row of its own (op `expire`).  An empty table gives none; other columns don't count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([("fact_id", pa.int64()), ("at", pa.int64()), ("seq", pa.int64()), ("op", pa.string()), ("changed", pa.bool_()), *((c, pa.string()) for c in ("state", "tier", "lifecycle", "freshness_reason")), *((c, pa.int64()) for c in ("validated_at", "asked_at", "approved_at")), ("approval_reason", pa.string()), ("n_moves", pa.int32()), ("last_move", pa.string())])

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), types)], schema=types)

        own, fact = None, None
        for some in (b.slice(low, AT_ONCE) for b in batches for low in range(0, b.num_rows, AT_ONCE)):
            out: list[tuple] = []
            for e in some.to_pylist():
                if e["fact_id"] != own:
                    out += expired(own, fact, expire_until) if expire_until is not None else []
                    own, fact = e["fact_id"], None
                fact, rows = advanced(own, fact, e, expire_until is not None)
                out += rows
            if out:
                yield batch_of(out)
        last = expired(own, fact, expire_until) if expire_until is not None else []
        if last:
            yield batch_of(last)

    rows = events.where("fact_id is not null").select(*EVENT_COLUMNS).withColumn("at", F.coalesce(F.col("at").cast("long"), F.lit(0)))
    dealt = rows.repartition("fact_id").sortWithinPartitions("fact_id", "at", "seq", "op")
    return dealt.mapInArrow(run, TRANSITION)


def latest(rows: DataFrame) -> DataFrame:
    """Each fact as its last transition left it."""
    place = F.struct("at", F.coalesce("seq", F.lit(1 << 62)))
    return rows.groupBy("fact_id").agg(*(F.max_by(c, place).alias(c) for c in rows.columns if c not in ("fact_id", "changed")))


def claim_part(text: Column) -> Column:
    """A claim's key or value as it is compared: lower case, single spaces, none around it."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def claim_classes(claims: DataFrame) -> DataFrame:
    """(claim_key, claim_value, n_facts, first_fact, since, n_conflicting, conflict_from): facts that claim one value of a
    key, how many claim another one, and from when on there were such.

    claims: fact_id, claim_key, claim_value, at.  Contradicting pairs are those between a class and the others of its key;
    they are counted, not listed.  Claims without a key or value contradict nothing and are left out."""
    rows = claims.select("fact_id", claim_part(F.col("claim_key")).alias("claim_key"), claim_part(F.col("claim_value")).alias("claim_value"), "at").where("claim_key <> '' and claim_value <> ''")
    once = rows.groupBy("claim_key", "claim_value", "fact_id").agg(F.min("at").alias("at"))
    values = once.groupBy("claim_key", "claim_value").agg(F.count("*").alias("n_facts"), F.min("fact_id").alias("first_fact"), F.min("at").alias("since"))
    # Of each key the two values that came first: the other value that came first is one of them.
    first = F.min_by(F.struct("since", "claim_value"), F.struct("since", "claim_value"))
    keys = values.groupBy("claim_key").agg(F.sum("n_facts").alias("n_key"), F.count("*").alias("n_values"), first.alias("one"))
    joined = join_by_share(values, keys, ["claim_key"], "n_values")
    second = joined.where(F.col("claim_value") != F.col("one.claim_value")).groupBy("claim_key").agg(F.min("since").alias("two"), F.count("*").alias("n_values"))
    out = join_by_share(joined.drop("n_values"), second, ["claim_key"], "n_values", "left")
    other = F.when(F.col("claim_value") != F.col("one.claim_value"), F.col("one.since")).otherwise(F.col("two"))
    return out.select("claim_key", "claim_value", "n_facts", "first_fact", "since", (F.col("n_key") - F.col("n_facts")).alias("n_conflicting"), F.greatest(other, F.when(other.isNotNull(), F.col("since"))).alias("conflict_from"), other.alias("other_since"))


def with_conflicts(events: DataFrame) -> DataFrame:
    """Events with conflict: whether, at its time, another fact had claimed another value of a key that the fact claims.

    events: also claim_key and claim_value, on those that stage or upsert.  Claims stay: a fact that changes its value has
    made both claims."""
    claims = events.where("op in ('stage', 'upsert') and fact_id is not null").select("fact_id", "claim_key", "claim_value", "at")
    classes = claim_classes(claims).select("claim_key", "claim_value", "n_facts", "other_since").where("other_since is not null")
    own = claims.withColumns({"claim_key": claim_part(F.col("claim_key")), "claim_value": claim_part(F.col("claim_value"))})
    since = join_by_share(own, classes, ["claim_key", "claim_value"], "n_facts").groupBy("fact_id").agg(F.min(F.greatest("at", "other_since")).alias("conflict_from"))
    return events.join(since, "fact_id", "left").withColumn("conflict", F.coalesce(F.col("at") >= F.col("conflict_from"), F.lit(False))).drop("conflict_from")

"""Classification of pending postings through a pluggable provider."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas


class Provider(Protocol):
    """classify: the key (content hash) and prompt of a posting to a JSON text."""

    model: str

    def classify(self, key: str, prompt: str) -> str: ...


def provider(name: str, made: dict[str, Callable[[], Provider]]) -> Provider:
    """The provider of a name; ValueError with the names there are, if it isn't one."""
    if name not in made:
        raise ValueError(f"unknown provider {name!r}; there are {', '.join(sorted(made))}")
    return made[name]()


def classify_many(provider: Provider, rows: Iterable[tuple[str, str]], most_failures: int = 5) -> Iterator[tuple[str, str]]:
    """(key, answer) for (key, prompt). A failure is passed over; after so many in a row the rest stays for a later run, and what was answered is kept."""
    failures = 0
    for key, prompt in rows:
        try:
            answer = provider.classify(key, prompt)
        except Exception:
            failures += 1
            if failures >= most_failures:
                return
            continue
        failures = 0
        yield key, answer


class Replay:
    """Recorded answers by content hash, so that a changed prompt does not hide a stale answer; one without a record is an error, never a guess."""

    model = "replay"

    def __init__(self, recorded: dict[str, str]):
        self.recorded = recorded

    def classify(self, key: str, prompt: str) -> str:
        return self.recorded[key]


def _broken(col: Column) -> Column:
    """Whether an answer breaks the contract: a field that isn't in it or of another type, a value outside its vocabulary or range, or no visa judgement."""
    known = {f.name: f.dataType for f in schemas.CLASSIFICATION}
    own = F.from_json(col, schemas.CLASSIFICATION)
    raw = lambda path: F.get_json_object(col, f"$.{path}")
    beyond = lambda text, names: F.size(F.array_except(F.json_object_keys(text), F.array(*map(F.lit, names)))) > 0
    outside = lambda value: (value < 0) | (value > 1)
    tests = [col.isNull(), F.json_object_keys(col).isNull(), beyond(col, known), raw("visa").isNull(), beyond(raw("visa"), schemas.VISA.names)]
    tests += [raw(n).isNotNull() & own[n].isNull() for n in known] + [raw(f"visa.{n}").isNotNull() & own["visa"][n].isNull() for n in schemas.VISA.names]
    tests += [raw(n).isNotNull() & ~raw(n).isin(*values) for n, values in (("seniority", schemas.SENIORITIES), ("employment_type", schemas.EMPLOYMENT_TYPES), ("remote_policy", schemas.REMOTE_POLICIES))]
    tests += [~F.coalesce(raw("visa.status"), F.lit("")).isin(*schemas.VISA_STATUSES), own["visa"]["confidence"].isNull(), outside(own["visa"]["confidence"]), outside(own["enrichment_confidence"])]
    tests += [F.length(raw("visa.evidence")) > 1000, F.length(raw("visa.reasoning")) > 500]
    return F.array_contains(F.array(*(F.coalesce(t, F.lit(False)) for t in tests)), True)


def parsed(answers: DataFrame, col: str = "answer") -> DataFrame:
    """Answers as columns. ``failed`` marks those that break the contract, which give no value; a vocabulary's field that is left out is unknown."""
    a = answers.withColumn("failed", _broken(F.col(col))).withColumn("a", F.when(~F.col("failed"), F.from_json(col, schemas.CLASSIFICATION)))
    known = lambda c: F.when(~F.col("failed"), F.coalesce(F.col(f"a.{c}"), F.lit("unknown"))).alias(c)
    plain = ("normalized_role", "role_family", "technologies", "requires_local_language", "working_languages", "english_sufficient", "relocation_support", "enrichment_confidence", "visa")
    return a.select(*answers.columns, "failed", *(F.col(f"a.{c}").alias(c) for c in plain), known("seniority"), known("employment_type"), known("remote_policy"))


def enrich_pending(batch: DataFrame, key: str, prompt: str, provider: Provider, upsert: Callable[[list[tuple[str, str]]], None], chunk: int = 10) -> int:
    """How many rows of a bounded batch were classified and upserted, in chunks, so that a stop loses one chunk at most."""
    done, held = 0, []
    rows = ((r[key], r[prompt]) for r in batch.select(key, prompt).toLocalIterator())
    try:
        for pair in classify_many(provider, rows):
            held.append(pair)
            if len(held) == chunk:
                upsert(held)
                done, held = done + len(held), []
    finally:
        if held:
            upsert(held)
    return done + len(held)

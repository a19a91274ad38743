"""Steps that an external model takes, as pluggable stages between native ones.

A stage sends text and gets text; a client is any function from a list of prompts to a list of answers, made once per
task by a factory. What surrounds the call (numbering, parsing, merging by index, filling gaps) is native.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.operators.records import json_object, merge_batch
from quillstream.schemas import KNOWLEDGE_TYPES, TESTABILITY

Client = Callable[[list[str]], list[str | None]]


def with_retries(client: Client, times: int = 3) -> Client:
    """Asks again for what failed or came back empty, up to ``times`` times; null where nothing came."""

    def run(prompts: list[str]) -> list[str | None]:
        out: list[str | None] = [None] * len(prompts)
        for _ in range(times):
            todo = [i for i, a in enumerate(out) if not a]
            if not todo:
                break
            try:
                for i, a in zip(todo, client([prompts[i] for i in todo])):
                    out[i] = a
            except OSError:
                continue
        return out

    return run


def ask(rows: DataFrame, prompt: str, answer: str, factory: Callable[[], Client], times: int = 3) -> DataFrame:
    """``rows`` with the model's answer to the text in ``prompt``; null prompts are not asked."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", `{answer}` string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = with_retries(factory(), times)
        for b in batches:
            asked = b[prompt].notna()
            got = pd.Series([None] * len(b), index=b.index, dtype=object)
            got[asked] = client(b.loc[asked, prompt].tolist())
            yield b.assign(**{answer: got})

    return rows.mapInPandas(run, schema)


def numbered(rows: DataFrame, group: list[str], idx: str, text: str) -> DataFrame:
    """One prompt per group: ``[i] text`` blocks in the order of the index."""
    block = F.struct(F.col(idx).alias("i"), F.concat(F.lit("["), F.col(idx).cast("string"), F.lit("] "), F.col(text)).alias("t"))
    return rows.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["t"]), "\n\n").alias("prompt"))


def classified(asked: DataFrame, answered: DataFrame, group: list[str], idx: str, schema: str) -> DataFrame:
    """Asked rows with the item of their index from the answers' JSON arrays; indices out of range are dropped, the
    last of several counts, and rows without any have a null ``item``."""
    items = answered.withColumn("items", F.from_json(F.get_json_object(F.coalesce(json_object("answer"), F.lit("{}")), "$.items"), f"array<struct<{schema}>>"))
    items = items.select(*group, F.posexplode("items").alias("pos", "item")).withColumn(idx, F.col("item.idx"))
    return merge_batch(asked, items, group, idx, "pos", "item")


def stub_classifier() -> Client:
    """A client without a model: classifies each numbered block by a hash of its text."""

    def run(prompts: list[str]) -> list[str | None]:
        out: list[str | None] = []
        for p in prompts:
            items = []
            for i, block in enumerate(p.split("\n\n")):
                h = int(hashlib.sha1(block.encode()).hexdigest(), 16)
                items.append({"idx": i, "knowledge_type": KNOWLEDGE_TYPES[h % 6], "testability": TESTABILITY[h // 6 % 3], "extraction_worthwhile": h % 5 != 0})
            out.append("```json\n" + json.dumps({"items": items}) + "\n```")
        return out

    return run


def stub_embedder(dims: int = 8) -> Client:
    """Vectors as JSON, from hashes of the texts."""

    def run(texts: list[str]) -> list[str | None]:
        return [json.dumps([b / 255 for b in hashlib.sha256(t.encode()).digest()[:dims]]) for t in texts]

    return run


@dataclass(frozen=True)
class Profile:
    """A bundle of prompts with the domains it tags records with."""

    name: str
    domains: tuple[str, ...] = ()
    prompts: dict[str, str] = field(default_factory=dict)


class Profiles:
    """Profiles by name; ``a+b`` takes a's wording before b's, and the domains of both, each once."""

    def __init__(self, *profiles: Profile):
        self._by_name = {p.name: p for p in profiles}

    def resolve(self, spec: str) -> Profile:
        parts = [self._by_name[n.strip()] for n in spec.split("+")]
        domains = tuple(dict.fromkeys(d for p in parts for d in p.domains))
        prompts: dict[str, str] = {}
        for p in reversed(parts):
            prompts |= p.prompts
        return Profile(spec, domains, prompts)

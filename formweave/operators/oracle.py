"""Judgements that a language model would make, behind deterministic and replaceable interfaces."""

from __future__ import annotations

import base64
import json
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Protocol

from pyspark.sql import Column, DataFrame, functions as F

from formweave.operators.replies import clean_reply

# USD per million tokens (in, out) and tokens that an image counts for.
PRICES = {"gpt-4o": (5.0, 20.0), "gpt-4o-mini": (0.3, 2.4)}
IMAGE_TOKENS = 1105
#: Phrases that one question asks about.
ASKED = 100


class Oracle(Protocol):
    cost: float

    def prepare(self, phrases: list[str]) -> None: ...

    def expect(self, prompts: list[str]) -> None: ...

    def is_keyword(self, text: Column) -> Column: ...

    def is_metadata_row(self, texts: list[str]) -> bool: ...

    def is_pair(self, key: str, value: str) -> bool: ...

    def keywords(self, texts: list[str]) -> list[str]: ...


@dataclass(frozen=True)
class RuleOracle:
    """Judges by form: a keyword starts with a letter, holds no digit and is short; pairs follow the fields.  It costs nothing."""

    fields: frozenset[str] = field(default=frozenset())
    cost: float = 0.0

    def prepare(self, phrases: list[str]) -> None:
        """Nothing to ask."""

    def expect(self, prompts: list[str]) -> None:
        """Nothing to ask."""

    def is_keyword(self, text: Column) -> Column:
        return text.rlike(r"^[A-Za-z][A-Za-z .#/()&'-]{1,40}$")

    def is_metadata_row(self, texts: list[str]) -> bool:
        return True

    def is_pair(self, key: str, value: str) -> bool:
        return key in self.fields and value not in self.fields

    def keywords(self, texts: list[str]) -> list[str]:
        return [t for t in texts if t in self.fields]


@dataclass
class ModelOracle:
    """Asks a model through ``ask(prompt, image)`` and counts what that costs.

    Equal questions are asked once.  ``prepare`` must see the phrases that ``is_keyword``
    is to judge; Engine and ``predict_field`` do so with the phrases of the sample's clusters.
    """

    ask: Callable[[str, str | None], str]
    model: str = "gpt-4o-mini"
    count: Callable[[str], int] = lambda text: len(text.split())
    cost: float = 0.0
    known: dict[tuple[str, str | None], str] = field(default_factory=dict)
    named: set[str] = field(default_factory=set)
    judged: set[str] = field(default_factory=set)

    def __post_init__(self):
        if self.model not in PRICES:
            raise ValueError(f"no model {self.model!r}; known are {sorted(PRICES)}")

    def expect(self, prompts: list[str]) -> None:
        """What will be asked soon; here each question is asked when it comes."""

    def reply(self, prompt: str, image: str | None = None) -> str:
        key = (prompt, image)
        if key not in self.known:
            self.known[key] = self.ask(prompt, image)
            price_in, price_out = PRICES[self.model]
            tokens = self.count(prompt) if image is None else IMAGE_TOKENS
            self.cost += (tokens * price_in + self.count(self.known[key]) * price_out) / 1e6
        return self.known[key]

    def keywords(self, texts: list[str]) -> list[str]:
        found: list[str] = []
        for k in range(0, len(texts), ASKED):
            part = texts[k : k + ASKED]
            reply = self.reply(keyword_prompt(part))
            if reply.strip().upper() != "NO":
                low = {p.lower() for p in clean_reply(reply, part)}
                found += [t for t in part if t.lower() in low]
        return found

    def prepare(self, phrases: list[str]) -> None:
        new = sorted(set(phrases) - self.judged)
        self.judged |= set(new)
        self.named |= set(self.keywords(new))

    def is_keyword(self, text: Column) -> Column:
        return text.isin(sorted(self.named))

    def is_metadata_row(self, texts: list[str]) -> bool:
        return _yes(self.reply(metadata_row_prompt(texts)))

    def is_pair(self, key: str, value: str) -> bool:
        return _yes(self.reply(pair_prompt(key, value)))

    def phrases_in(self, image: str) -> list[str]:
        """The phrases of a page image, the ground phrases of line merging."""
        return parts_of(self.reply(IMAGE_PHRASES, image))

    def fields_in(self, image: str) -> list[str]:
        """The field names of a page image, the vision fields of field prediction."""
        return parts_of(self.reply(IMAGE_FIELDS, image))

    def metadata_in(self, image: str) -> list[str]:
        """The header and footer strings of a page image."""
        return parts_of(self.reply(IMAGE_METADATA, image))


def ReplayOracle(replies: dict[str, str], model: str = "gpt-4o-mini") -> ModelOracle:
    """An oracle with recorded replies by prompt (and image, after a line end); an unknown question fails."""

    def ask(prompt: str, image: str | None) -> str:
        key = prompt if image is None else f"{prompt}\n{image}"
        if key not in replies:
            raise KeyError(f"no recorded reply for {key[:80]!r}")
        return replies[key]

    return ModelOracle(ask, model)


# The questions.  Lists are separated by ``|`` both ways.

IMAGE_PHRASES = "List every separate piece of text of this page, separated by |, in reading order. Give nothing else."
IMAGE_FIELDS = "List the field names and column headings of this form, separated by |. Give nothing else."
IMAGE_METADATA = "List the texts of this page's header and footer, separated by |. Give nothing else."


def keyword_prompt(texts: list[str]) -> str:
    return "Which of these phrases name a field or a column? Answer with them separated by |, or with NO. Phrases: " + "|".join(texts)


def metadata_row_prompt(texts: list[str]) -> str:
    return "Is this row part of a page's header or footer? Answer yes or no. Row: " + "|".join(texts)


def pair_prompt(key: str, value: str) -> str:
    return f"Is the second phrase a value of the field that the first one names? Answer yes or no. Phrases: {key}|{value}"


def header_prompt(rows: list[str]) -> str:
    return "These are the rows of a document's first page. Which of their texts are its header or footer? Answer with them separated by |. Rows: " + "|".join(rows)


def _yes(reply: str) -> bool:
    return "yes" in reply.lower()


def parts_of(reply: str) -> list[str]:
    """The different parts of a reply that are not blank, in order."""
    return list(dict.fromkeys(p.strip() for p in reply.split("|") if p.strip()))


def http_model(url: str, key: str, model: str = "gpt-4o-mini", timeout: float = 60.0) -> Callable[[str, str | None], str]:
    """``ask`` of a service that takes chat messages as JSON; an image is the path of a JPEG file."""

    def ask(prompt: str, image: str | None) -> str:
        content: str | list = prompt
        if image is not None:
            data = base64.b64encode(Path(image).read_bytes()).decode()
            content = [{"type": "text", "text": prompt}, {"type": "image_url", "image_url": {"url": f"data:image/jpeg;base64,{data}"}}]
        body = json.dumps({"model": model, "temperature": 0, "messages": [{"role": "user", "content": content}]}).encode()
        request = urllib.request.Request(url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
        with urllib.request.urlopen(request, timeout=timeout) as response:
            return json.load(response)["choices"][0]["message"]["content"]

    return ask


def call_cost(model: Column, tokens_in: Column, tokens_out: Column, images: Column) -> Column:
    """USD of a call; a vision model pays for its images instead of the prompt's tokens, an unknown model nothing."""
    cost = F.lit(0.0)
    for name, (price_in, price_out) in PRICES.items():
        cost = F.when(model == name, (tokens_in * price_in + tokens_out * price_out) / 1e6).when(
            model == f"{name}-vision", (images * IMAGE_TOKENS * price_in + tokens_out * price_out) / 1e6
        ).otherwise(cost)
    return cost


def total_cost(costs: DataFrame, group: list[str], cost: str = "cost") -> DataFrame:
    """(group, cost): the costs of a run's stages in sum; a null counts nothing."""
    return costs.groupBy(*group).agg(F.coalesce(F.sum(cost), F.lit(0.0)).alias("cost"))


def answered(prompts: DataFrame, answers: DataFrame) -> DataFrame:
    """Prompts with their recorded replies, null where there is none; of several replies to a prompt, the least."""
    return prompts.join(answers.groupBy("prompt").agg(F.min("reply").alias("reply")), "prompt", "left")


def metadata_strings(rows: DataFrame, share: float = 0.5, least: int = 3) -> DataFrame:
    """(doc_id, text) of rows that recur on a share of a document's pages, digits apart: headers and footers without a model."""
    shape = F.expr("array_join(transform(cells, c -> regexp_replace(c.text, '[0-9]+', '#')), '|')")
    pages = rows.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    found = rows.select("doc_id", "page", shape.alias("shape"), F.expr("cells.text").alias("texts"), F.expr("cells[0].y0").alias("y"))
    same = found.groupBy("doc_id", "shape", "y").agg(F.count_distinct("page").alias("n"), F.collect_set("texts").alias("t")).join(pages, "doc_id")
    return same.where((F.col("n") >= share * F.col("pages")) & (F.col("n") >= least)).select("doc_id", F.explode(F.array_distinct(F.flatten("t"))).alias("text")).distinct()

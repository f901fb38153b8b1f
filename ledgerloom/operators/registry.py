"""Parsers, their confidence in a batch of files, and the choice among them.

A parser scores single files (None: not its kind) and turns a file into invoices. Scores are averaged
over a run's files by a grouped aggregate; the best parser of each run is an argmax, ties to the one
registered first. Files are (run_id, pos, name, content); one pass over them per step.
"""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import extract

MIN_CONFIDENCE = 0.3
ITEM = "code string, name string, description string, qty double, unit string, unit_price double, total double, metadata map<string,string>"
INVOICE = f"source_file string, format_detected string, supplier_name string, customer_name string, invoice_date string, invoice_number string, declared_total double, calc_total double, currency string, items array<struct<{', '.join(x.replace(' ', ':', 1) for x in ITEM.split(', '))}>>"
#: Words that raise the confidence in Markdown and text.
MARKDOWN_HIGH = ("total", "amount", "qty", "quantity", "price", "金额", "數量", "单价", "合计")
MARKDOWN_MEDIUM = ("invoice", "發票", "销售单", "收據", "item", "product")
TEXT_WORDS = ("total", "amount", "qty", "price", "金额", "數量", "单价", "合计")
#: Fixed value: a pipe table's head.
_PIPES = re.compile(r"\|.+\|[\r\n]+\|[\-:]+\|")


def extension(name: str) -> str:
    return name.rpartition(".")[2].lower()


def score_page(name: str, text: str) -> float | None:
    page = extract.load_json(text) if extension(name) == "json" else None
    if not page:
        return None
    root = page if isinstance(page, dict) else {}
    root = next((root[k] for k in ("result", "data") if isinstance(root.get(k), dict)), root)
    score = 0.0
    if isinstance(root.get("parsing_res_list"), list):
        score += 0.5
        first = (root["parsing_res_list"] or [None])[0]
        if isinstance(first, dict):
            score += 0.3 * (first.get("block_label") is not None and first.get("block_content") is not None) + 0.2 * (first.get("block_bbox") is not None)
    return score + 0.1 * (root.get("layout_det_res") is not None) + 0.1 * (root.get("model_settings") is not None)


def score_markdown(name: str, text: str) -> float | None:
    if extension(name) not in ("md", "txt") or not text:
        return None
    low = text.lower()
    score = 0.4 * ("<table" in low) + 0.3 * bool(_PIPES.search(text))
    return min(0.8, score + 0.08 * sum(w in low for w in MARKDOWN_HIGH) + 0.04 * sum(w in low for w in MARKDOWN_MEDIUM))


def score_text(name: str, text: str) -> float | None:
    if extension(name) == "json":
        page = extract.load_json(text)
        if not page:
            return None
        labels = [str(b.get("block_label") or "").lower() for b in extract.blocks_of(page)]
        has_text = any(x in ("text", "paragraph", "title") for x in labels)
        return 0.0 if not has_text else 0.2 if any("table" in x for x in labels) else 0.8
    if extension(name) not in ("md", "txt") or not text:
        return None
    low = text.lower()
    return 0.6 if "<table" not in low and not _PIPES.search(text) and sum(w in low for w in TEXT_WORDS) >= 2 else 0.0


@dataclass(frozen=True)
class Parser:
    """id, name, extensions; score(name, text) of one file; parse(name, text) to invoices."""

    id: str
    name: str
    extensions: tuple[str, ...]
    score: Callable[[str, str], float | None]
    parse: Callable[[str, str], list[dict]]
    enabled: bool = True


def model_parser(ask: Callable[[str], str] | None = None) -> Parser:
    """A parser that asks a language model through ``ask``; without one it is disabled and scores 0.

    Calls that fail to reach the model or run out of time (OSError, TimeoutError) skip the file, with a
    warning; other faults of ``ask`` are its own and end the job. Time limits are the caller's to set in ``ask``.
    """

    def parse(name: str, text: str) -> list[dict]:
        try:
            answer = ask(prompt(extract.model_content(name, text)))
        except OSError as e:  # TimeoutError and ConnectionError are OSErrors
            warnings.warn(f"{name}: {e}", stacklevel=2)
            return []
        return extract.model_invoice(name, answer)

    score = lambda name, text: 0.3 if ask and extension(name) in ("json", "md", "txt") else None
    return Parser("llm_assisted", "Language model", ("json", "md", "txt"), score, parse, ask is not None)


def prompt(content: str) -> str:
    keys = {"supplier_name": "", "customer_name": "", "invoice_date": "YYYY-MM-DD", "invoice_number": "", "currency": "HKD", "declared_total": 0, "items": [{"code": "", "name": "", "qty": 0, "unit_price": 0, "total": 0}]}
    return f"Extract the invoice below as one JSON object with exactly these keys, and nothing else:\n{json.dumps(keys)}\n\n{content}"


def standard(ask: Callable[[str], str] | None = None) -> dict[str, Parser]:
    parsers = (
        Parser("doc_parser_json", "OCR page JSON", ("json",), score_page, extract.page_json),
        Parser("generic_markdown", "Markdown", ("md", "txt"), score_markdown, extract.markdown),
        Parser("text_block", "Text blocks", ("json", "md", "txt"), score_text, extract.text_block),
        model_parser(ask),
    )
    return {p.id: p for p in parsers}


@dataclass
class Registry:
    """Ordered parsers; registering an id again keeps its place."""

    parsers: dict[str, Parser] = field(default_factory=standard)
    min_confidence: float = MIN_CONFIDENCE
    validator: Callable[[DataFrame], DataFrame] | None = None
    auto_validate: bool = True

    def register(self, parser: Parser) -> Registry:
        self.parsers[parser.id] = parser
        return self

    def unregister(self, parser_id: str) -> Registry:
        self.parsers.pop(parser_id, None)
        return self

    def get(self, parser_id: str) -> Parser | None:
        return self.parsers.get(parser_id)

    def all(self) -> dict[str, Parser]:
        return dict(self.parsers)

    def set_min_confidence(self, value: float) -> Registry:
        self.min_confidence = min(1.0, max(0.0, value))
        return self

    def set_validator(self, validator: Callable[[DataFrame], DataFrame] | None) -> Registry:
        self.validator = validator
        return self

    def set_auto_validate(self, on: bool) -> Registry:
        self.auto_validate = on
        return self

    def configure_model(self, ask: Callable[[str], str] | None) -> Registry:
        return self.register(model_parser(ask))

    def supported_extensions(self) -> list[str]:
        return list(dict.fromkeys(e for p in self.parsers.values() for e in p.extensions))

    def info(self, files: DataFrame) -> DataFrame:
        rows = [(p.id, p.name, ",".join(p.extensions), p.enabled) for p in self.parsers.values()]
        return files.sparkSession.createDataFrame(rows, "id string, name string, extensions string, enabled boolean")

    def scores(self, files: DataFrame) -> DataFrame:
        """run_id, parser_id, ord, confidence: mean over the files that a parser can judge, 1 at most, 0 if none."""
        parsers = list(self.parsers.values())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [
                    {"run_id": r, "parser_id": p.id, "ord": k, "score": p.score(n, t or "") if p.enabled else None}
                    for r, n, t in zip(*(b.column(c).to_pylist() for c in ("run_id", "name", "content")), strict=True)
                    for k, p in enumerate(parsers)
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("run_id", pa.string()), ("parser_id", pa.string()), ("ord", pa.int32()), ("score", pa.float64())]))

        each = files.select("run_id", "name", "content").mapInArrow(run, "run_id string, parser_id string, ord int, score double")
        return each.groupBy("run_id", "parser_id", "ord").agg(F.least(F.lit(1.0), F.coalesce(F.avg("score"), F.lit(0.0))).alias("confidence"))

    def detect(self, files: DataFrame) -> DataFrame:
        """run_id, parser_id, confidence of the best parser; null if none reaches the least confidence."""
        best = self.scores(files).groupBy("run_id").agg(F.max_by("parser_id", F.struct("confidence", -F.col("ord"))).alias("id"), F.max("confidence").alias("confidence"))
        return best.select("run_id", F.when(F.col("confidence") >= self.min_confidence, F.col("id")).alias("parser_id"), "confidence")

    def _parsed(self, chosen: DataFrame) -> DataFrame:
        parsers = self.parsers
        schema = f"run_id string, pos int, parser_id string, {INVOICE}"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for r, k, n, t, p in zip(*(b.column(c).to_pylist() for c in ("run_id", "pos", "name", "content", "parser_id")), strict=True):
                    if p in parsers:
                        rows += [{"run_id": r, "pos": k, "parser_id": p, **i, "items": [x | {"metadata": list(x["metadata"].items())} for x in i["items"]]} for i in parsers[p].parse(n, t or "")]
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

        return chosen.select("run_id", "pos", "name", "content", "parser_id").mapInArrow(run, schema)

    def parse(self, files: DataFrame, force: str | None = None) -> DataFrame:
        """Invoices of every run by its best parser, or by ``force`` (``auto``: none forced); validated if a validator is set."""
        if force and force != "auto":
            if force not in self.parsers:
                raise ValueError(f"unknown parser {force}")
            chosen = files.withColumn("parser_id", F.lit(force))
        else:
            chosen = files.join(self.detect(files).where("parser_id is not null").select("run_id", "parser_id"), "run_id")
        out = self._parsed(chosen)
        return self.validator(out) if self.validator and self.auto_validate else out

    def parse_with_fallback(self, files: DataFrame) -> DataFrame:
        """Invoices of every run by the best parser that finds any."""
        able = self.scores(files).where(F.col("confidence") >= self.min_confidence)
        made = self._parsed(files.join(able.select("run_id", "parser_id"), "run_id"))
        order = Window.partitionBy("run_id").orderBy(F.desc("confidence"), "ord")
        won = made.select("run_id", "parser_id").distinct().join(able, ["run_id", "parser_id"]).withColumn("n", F.row_number().over(order)).where("n = 1")
        return made.join(won.select("run_id", "parser_id"), ["run_id", "parser_id"], "left_semi")


_ITEM = pa.struct([("code", pa.string()), ("name", pa.string()), ("description", pa.string()), ("qty", pa.float64()), ("unit", pa.string()), ("unit_price", pa.float64()), ("total", pa.float64()), ("metadata", pa.map_(pa.string(), pa.string()))])
ARROW = pa.schema([("run_id", pa.string()), ("pos", pa.int32()), ("parser_id", pa.string()), *((n, pa.string()) for n in ("source_file", "format_detected", "supplier_name", "customer_name", "invoice_date", "invoice_number")), ("declared_total", pa.float64()), ("calc_total", pa.float64()), ("currency", pa.string()), ("items", pa.list_(_ITEM))])

"""Extraction kernel: one file in, invoices out. Runs inside mapInArrow, once per file.

Tables with spans, header patterns and free-text items need state within a document, so this part is
plain Python over one text at a time; everything after it (validation, loading, reports) is DataFrame
expressions over the exploded items.
"""

from __future__ import annotations

import json
import math
import re
from decimal import ROUND_HALF_UP, Decimal
from html.parser import HTMLParser

import regex

from ..functions.fields import map_header

#: Header words of item tables and their scores.
TABLE_WORDS = (
    (0.15, ("qty", "quantity", "price", "amount", "total", "數量", "单价", "單價", "金额", "金額", "合计", "合計")),
    (0.08, ("item", "product", "description", "code", "品名", "名称", "名稱", "货品", "貨品", "款号", "款號")),
    (0.03, ("unit", "size", "color", "规格", "規格", "颜色", "顏色", "备注", "備註")),
)
#: Patterns of header fields, in the order in which they are tried: of page blocks, and of running text.
PAGE = {
    "supplier": (r"供[应應]商[：:]\s*([^\n]+)", r"(?i)from[:\s]+([^\n]+)", r"(?i)vendor[:\s]+([^\n]+)"),
    "customer": (r"客[户戶][：:]\s*([^\n]+)", r"(?i)to[:\s]+([^\n]+)", r"(?i)bill\s*to[:\s]+([^\n]+)"),
    "date": (r"日期[：:]\s*(\d{4}[-/]\d{1,2}[-/]\d{1,2})", r"(?i)date[:\s]+(\d{4}[-/]\d{1,2}[-/]\d{1,2})", r"(\d{4})年(\d{1,2})月(\d{1,2})日", r"(\d{4}[-/]\d{1,2}[-/]\d{1,2})"),
    "number": (r"發票[号號][：:]\s*([A-Za-z0-9\-]+)", r"(?i)invoice\s*#?\s*[:\s]*([A-Za-z0-9\-]+)", r"批次[：:]\s*(\d+)", r"(?i)order\s*#?\s*[:\s]*([A-Za-z0-9\-]+)"),
    "total": (r"本單額[：:]\s*([\d,]+\.?\d*)", r"(?i)grand\s*total[:\s]*\$?\s*([\d,]+\.?\d*)", r"(?i)total[:\s]*\$?\s*([\d,]+\.?\d*)", r"合[计計][：:]\s*[\$¥￥]?\s*([\d,]+\.?\d*)"),
}
TEXT = {
    "supplier": (r"供[应應]商[：:]\s*([^\n\r]+)", r"供[货貨]商[：:]\s*([^\n\r]+)", r"(?i)vendor[:\s]+([^\n\r]+)", r"(?i)supplier[:\s]+([^\n\r]+)", r"(?i)from[:\s]+([^\n\r]+)", r"公司[：:]\s*([^\n\r]+)"),
    "customer": (r"客[户戶][：:]\s*([^\n\r]+)", r"買[家方][：:]\s*([^\n\r]+)", r"(?i)customer[:\s]+([^\n\r]+)", r"(?i)bill\s*to[:\s]+([^\n\r]+)", r"(?i)sold\s*to[:\s]+([^\n\r]+)", r"(?i)to[:\s]+([^\n\r]+)"),
    "date": (
        r"日期[：:]\s*(\d{4}[-/]\d{1,2}[-/]\d{1,2})", r"(?i)date[:\s]+(\d{4}[-/]\d{1,2}[-/]\d{1,2})", r"(\d{4}[-/]\d{1,2}[-/]\d{1,2})",
        r"日期[：:]\s*(\d{1,2}[-/]\d{1,2}[-/]\d{4})", r"(?i)date[:\s]+(\d{1,2}[-/]\d{1,2}[-/]\d{4})", r"(\d{4})年(\d{1,2})月(\d{1,2})日",
    ),
    "number": (
        r"發票[号號][：:]\s*([A-Za-z0-9\-]+)", r"(?i)invoice\s*(?:#|no\.?|number)[:\s]*([A-Za-z0-9\-]+)", r"單[号號][：:]\s*([A-Za-z0-9\-]+)", r"批次[：:]\s*(\d+)",
        r"(?i)ref(?:erence)?[:\s]*([A-Za-z0-9\-]+)", r"(?i)order\s*(?:#|no\.?)[:\s]*([A-Za-z0-9\-]+)",
    ),
    "total": (
        r"(?i)grand\s*total[:\s]*\$?\s*([\d,]+\.?\d*)", r"(?i)total\s*(?:amount|due)?[:\s]*\$?\s*([\d,]+\.?\d*)", r"合[计計][：:]\s*[\$¥￥€£]?\s*([\d,]+\.?\d*)",
        r"總[数數額额][：:]\s*[\$¥￥€£]?\s*([\d,]+\.?\d*)", r"本單額[：:]\s*[\$¥￥€£]?\s*([\d,]+\.?\d*)", r"(?i)amount\s*(?:payable|due)[:\s]*\$?\s*([\d,]+\.?\d*)",
    ),
}
#: Fixed values, up to PIPES and the merged-file patterns: company words, currencies, summary and skipped rows, item notations.
COMPANY_PAGE = regex.compile(r"有限公司|co\.?\s*ltd|trading|enterprise", regex.I)
COMPANY_TEXT = regex.compile(r"有限公司|co\.?\s*ltd|company|trading|enterprise|inc\.?|corp\.?", regex.I)
CURRENCY = (("CNY", r"¥|￥|rmb|人民币|人民幣"), ("HKD", r"hk\$|hkd|港币|港幣"), ("USD", r"\$(?!hk)|usd|us\$|美元|美金"), ("EUR", r"€|eur|欧元|歐元"), ("GBP", r"£|gbp|英镑|英鎊"))
SUMMARY = regex.compile(r"合计|total|subtotal|grand|小計|sum", regex.I)
SKIP = regex.compile(r"合计|total|subtotal|grand|小計|#|序号|項次", regex.I)
MULTIPLIED = (
    regex.compile(r"([^\d\n]+?)\s*[x×]\s*(\d+(?:\.\d+)?)\s*[@＠]\s*(\d+(?:\.\d+)?)", regex.I),
    regex.compile(r"([^\d\n]+?)\s*(\d+(?:\.\d+)?)\s*(?:pcs?|件)?\s*[@＠]\s*[\$¥￥]?\s*(\d+(?:\.\d+)?)", regex.I),
)
LISTED = regex.compile(r"^[*\-•\d.]+\s*(.+?)[\s\-]+[\$¥￥]?\s*([\d,]+\.?\d*)$", regex.M)
AMOUNT = re.compile(r"[\d,]+\.?\d*", re.A)
PIPES = re.compile(r"\|[^\n]+\|[\r\n]+\|[\-:\|\s]+\|[\r\n]+(?:\|[^\n]+\|[\r\n]*)+")
MERGED_NAME = re.compile(r"merge|combined|all", re.I)
MERGED_HEAD = re.compile(r"^#{1,3}\s+.*(?:invoice|發票|销售单|收據)", re.I | re.M)
BAND = 50
#: Columns or rows that a cell spans, at most, as in HTML.
MOST_SPAN = 1000
LEAST_TABLE_SCORE = 0.3


def squeeze(s: str | None) -> str:
    return " ".join((s or "").split())


_UNITS = {places: Decimal(1).scaleb(-places) for places in (2, 4)}


def half_up(x: float, places: int) -> float:
    """Rounded half away from zero on the shortest decimal form; numbers too large to have such places stay."""
    x = float(x)
    return float(Decimal(repr(x)).quantize(_UNITS[places], ROUND_HALF_UP)) if abs(x) < 1e15 else x


def finite(digits: str) -> float:
    """The number that digits spell; 0 if it is too large to be one."""
    x = float(digits)
    return x if math.isfinite(x) else 0.0


def first_number(s: str) -> float:
    m = re.search(r"-?[\d.]+", re.sub(r"[¥￥$€£\s,]", "", s), re.A)
    m = m and re.match(r"-?(?:\d+\.?\d*|\.\d+)", m[0], re.A)
    return finite(m[0]) if m else 0.0


class _Tables(HTMLParser):
    """Cells of every table as (text, colspan, rowspan); a nested table's rows count for the outer one too."""

    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[list]]] = []
        self.open: list[list] = []
        self.cell: list = []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
            self.open.append(self.tables[-1])
        elif tag == "tr" and self.open:
            row: list = []
            for t in self.open:
                t.append(row)
        elif tag in ("td", "th") and self.open and self.open[-1]:
            a = dict(attrs)
            size = lambda k: max(1, min(MOST_SPAN, int(m[1][:9]))) if (m := re.match(r"\s*(\d+)", a.get(k) or "", re.A)) else 1
            self.cell.append(["", size("colspan"), size("rowspan")])
            self.open[-1][-1].append(self.cell[-1])
        elif tag == "br" and self.cell:
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if tag == "table" and self.open:
            self.open.pop()
        elif tag in ("td", "th") and self.cell:
            self.cell.pop()

    def handle_data(self, data):
        for c in self.cell:
            c[0] += data


def html_tables(html: str, spans: bool = True) -> list[list[list[str]]]:
    """Rows of each table. With spans, columns are padded, row spans repeat downwards and rows are of one width."""
    p = _Tables()
    p.feed(html)
    p.close()
    out = []
    for table in p.tables:
        if not spans:
            rows = [[squeeze(c[0]) for c in row] for row in table]
        else:
            rows, down = [], {}
            for cells in table:
                row, todo = [], [(clean_cell(c[0]), c[1], c[2]) for c in cells]
                while todo or len(row) in down:
                    at = len(row)
                    if at in down:
                        text, left = down.pop(at)
                        row.append(text)
                        if left > 1:
                            down[at] = (text, left - 1)
                        continue
                    text, wide, high = todo.pop(0)
                    row += [text] + [""] * (wide - 1)
                    if high > 1:
                        down[at] = (text, high - 1)
                rows.append(row)
            width = max(map(len, rows), default=0)
            rows = [r + [""] * (width - len(r)) for r in rows]
        rows = [r for r in rows if r]
        if rows:
            out.append(rows)
    return out


def clean_cell(s: str) -> str:
    s = squeeze(s)
    return "" if s and not s.strip("|-+ ") else s


def pipe_tables(markdown: str) -> list[list[list[str]]]:
    """Rows of each pipe table; empty cells in front of a row are dropped, inner ones stay."""
    out = []
    for m in PIPES.finditer(markdown):
        rows = []
        for line in re.split(r"[\r\n]+", m[0]):
            if not line.strip() or re.fullmatch(r"[\|\-:\s]+", line):
                continue
            cells = [clean_cell(c) for c in line.strip().split("|")]
            while cells and not cells[0]:
                cells.pop(0)
            if cells and not cells[-1]:
                cells.pop()
            if cells:
                rows.append(cells)
        if rows:
            out.append(rows)
    return out


def table_score(rows: list[list[str]]) -> float:
    """How much a table looks like invoice items: header words, row count, a plain number below the header."""
    if len(rows) < 2:
        return 0.0
    head = " ".join(rows[0]).lower()
    score = sum(weight for weight, words in TABLE_WORDS for w in words if w in head)
    body = rows[1:]
    score += min(0.2, 0.02 * len(body)) if len(body) <= 100 else 0
    score += 0.15 if any(re.fullmatch(r"\d+(?:[.,]\d+)?", c.strip(), re.A) for r in body for c in r) else 0
    return min(1.0, score)


def best_table(tables: list[list[list[str]]], least: float | None = None) -> list[list[str]] | None:
    """The first of highest score; none if that is under ``least``."""
    if not tables:
        return None
    best = max(tables, key=table_score)
    return best if least is None or table_score(best) >= least else None


def complete(qty: float, price: float, total: float) -> tuple[float, float, float]:
    """Missing numbers from the other two; a quantity close to a whole number becomes it."""
    if qty <= 0 < price and total > 0 and math.isfinite(total / price):
        qty = total / price
        qty = float(round(qty)) if abs(qty - round(qty)) < 0.01 else qty
    qty = qty if qty > 0 else 1.0
    if price <= 0 < total:
        price = total / qty
    if total <= 0 < price:
        total = qty * price
    return qty, price, total


def item(name: str, qty: float, price: float, total: float, code: str = "", **metadata: str) -> dict:
    return {"code": code, "name": name, "qty": half_up(qty, 4), "unit_price": half_up(price, 4), "total": half_up(total, 2), "metadata": metadata}


def table_items(rows: list[list[str]]) -> list[dict]:
    """Items below a header row; summary rows and rows without code and name are left out."""
    columns = map_header(rows[0])
    out = []
    for row in rows[1:]:
        get = lambda f: row[columns[f]].strip() if columns.get(f, len(row)) < len(row) else ""  # noqa: B023, E731
        code, name = get("code"), get("name")
        if SUMMARY.fullmatch(code) or SUMMARY.fullmatch(name) or not (code or name):
            continue
        numbers = complete(*(first_number(get(f)) for f in ("qty", "unit_price", "total")))
        color, size = get("color"), get("size")
        full = name + (f" - {color}" if color else "") + (f" [{size}]" if size else "")
        out.append(item(full, *numbers, code=code, color=color, size=size, remark=get("remark")))
    return out


def item_name(s: str) -> str:
    s = re.sub(r"^[\d.)\]\-*•\s]+", "", s, flags=re.A)
    return squeeze(re.sub(r"[\s\-*]+$", "", s))


def amounts(s: str) -> list[float]:
    found = []
    for m in AMOUNT.findall(s):
        digits = m.replace(",", "")
        if digits.strip(".") and finite(digits) > 0:
            found.append(finite(digits))
    return found


def by_numbers(text: str, checked: bool) -> tuple[str, float, float, float] | None:
    """(name, qty, price, total) of a line by how many numbers it holds; checked: only if they fit within 10 %."""
    numbers, name = amounts(text), item_name(AMOUNT.sub("", text))
    if not numbers or len(name) < 2:
        return None
    qty, price, total = 1.0, 0.0, numbers[-1]
    if len(numbers) >= 3:
        qty, price, total = numbers[:3]
    elif len(numbers) == 2:
        a, total = numbers
        if a <= 100 and a < total:
            qty, price = a, total / a
        else:
            qty, price = (total / a if checked else 1.0), a
    if checked and (total <= 0 or abs(qty * price - total) / total >= 0.1):
        return None
    return name, qty, price, total


def text_items(text: str) -> list[dict]:
    """Items of running text by all three notations; the first of equal name, quantity and total stays."""
    found = []
    for pattern in MULTIPLIED:
        for m in pattern.finditer(text):
            name, qty, price = item_name(m[1]), finite(m[2]), finite(m[3])
            if len(name) >= 2 and qty > 0 and price > 0:
                found.append(item(name, qty, price, qty * price, parse_method="multiplication"))
    for line in text.split("\n"):
        line = line.strip()
        if line and not SKIP.match(line) and (got := by_numbers(line, True)):
            found.append(item(*got, parse_method="line"))
    for m in LISTED.finditer(text):
        name, total = item_name(m[1]), sum(amounts(m[2])[:1])
        if len(name) >= 2 and total > 0:
            found.append(item(name, 1.0, total, total, parse_method="list"))
    return list({(i["name"].lower(), i["qty"], i["total"]): i for i in reversed(found)}.values())[::-1]


def bands(blocks: list[tuple[float, str]]) -> list[list[str]]:
    """Texts of blocks by vertical position; a gap of BAND or more to the block before starts a new band."""
    out: list[list[str]] = []
    last = None
    for y, text in sorted(blocks, key=lambda b: b[0]):
        if last is None or abs(y - last) >= BAND:
            out.append([])
        out[-1].append(text)
        last = y
    return out


def block_items(blocks: list[tuple[float, str]]) -> list[dict]:
    return [item(*got, parse_method="block_group") for band in bands(blocks) if (got := by_numbers(" ".join(band), False))]


def first_of(patterns: tuple[str, ...], text: str) -> re.Match | None:
    return next((m for p in patterns if (m := re.search(p, text))), None)


def last_total(patterns: tuple[str, ...], text: str) -> float | None:
    """Of all patterns' matches, the value that stands last."""
    hits = [(m.start(1), m[1]) for p in patterns for m in re.finditer(p, text, re.A)]
    if not hits:
        return None
    top = max(h[0] for h in hits)
    digits = next(v for at, v in hits if at == top).replace(",", "")
    return finite(digits) if digits.strip(".") else None


def iso_text(s: str) -> str | None:
    """Month first unless the first part is over 12; not calendar-checked."""
    p = s.replace("/", "-").split("-")
    if len(p) != 3:
        return None
    if len(p[0]) == 4:
        y, m, d = p
    elif len(p[2]) == 4:
        y, m, d = (p[2], p[1], p[0]) if int(p[0]) > 12 else (p[2], p[0], p[1])
    else:
        return None
    return f"{int(y):04d}-{int(m):02d}-{int(d):02d}"


def found_date(patterns: tuple[str, ...], text: str) -> str | None:
    m = first_of(patterns, text)
    if m is None:
        return None
    return "{:04d}-{:02d}-{:02d}".format(*map(int, m.groups())) if len(m.groups()) == 3 else iso_text(m[1])


def entity_name(s: str) -> str:
    return re.sub(r"^(?:供[应應]商|vendor|supplier|from)[:\s]*", "", squeeze(s), flags=re.I)


def text_header(text: str) -> dict:
    """supplier, customer, date, number, total, currency of running text."""
    m = first_of(TEXT["supplier"], text)
    supplier = entity_name(m[1]) if m else ""
    if not m:
        for line in map(str.strip, text.split("\n")):
            if not re.match(r"\d{4}[-/]|[#*\-]", line) and 5 < len(line.encode()) < 100 and COMPANY_TEXT.search(line):
                supplier = entity_name(line)
                break
    c, n = first_of(TEXT["customer"], text), first_of(TEXT["number"], text)
    currency = next((k for k, p in CURRENCY if re.search(p, text, re.I)), None)
    return {"supplier_name": supplier, "customer_name": entity_name(c[1]) if c else "", "invoice_date": found_date(TEXT["date"], text), "invoice_number": n[1].strip() if n else None, "declared_total": last_total(TEXT["total"], text), "currency": currency}


def page_header(blocks: list[str]) -> dict:
    """The same of a page's text blocks."""
    text = "\n".join(blocks)
    m = first_of(PAGE["supplier"], text)
    supplier = m[1].strip() if m else ""
    if not m:
        for b in blocks:
            if re.match(r"\d{4}[-/]", b):
                continue
            if COMPANY_PAGE.search(b) or (3 < len(b) < 100 and not re.match(r"\d", b)):
                supplier = b.strip()
                break
    c, n = first_of(PAGE["customer"], text), first_of(PAGE["number"], text)
    return {"supplier_name": supplier, "customer_name": c[1].strip() if c else "", "invoice_date": found_date(PAGE["date"], text), "invoice_number": n[1].strip() if n else None, "declared_total": last_total(PAGE["total"], text), "currency": None}


def invoice(source: str, how: str, header: dict, items: list[dict]) -> dict | None:
    """The normalised invoice, or none without items."""
    if not items:
        return None
    out = []
    for i in items:
        qty = i["qty"] if i["qty"] > 0 else 1.0
        total = i["total"] or qty * i["unit_price"]
        price = i["unit_price"] or (total / qty if total else 0.0)
        out.append({"code": squeeze(i["code"]), "name": squeeze(i["name"]), "description": "", "unit": "", "qty": half_up(qty, 4), "unit_price": half_up(price, 4), "total": half_up(total, 2), "metadata": {k: v for k, v in i["metadata"].items() if v}})
    return {"source_file": source, "format_detected": how, **header, "calc_total": half_up(sum(i["total"] for i in items), 2), "items": out}


def blocks_of(page: object) -> list[dict]:
    root = page if isinstance(page, dict) else {}
    root = next((root[k] for k in ("result", "data") if isinstance(root.get(k), dict)), root)
    found = root.get("parsing_res_list")
    return [b for b in found if isinstance(b, dict)] if isinstance(found, list) else []


def load_json(text: str) -> object:
    try:
        return json.loads(text)
    except (ValueError, RecursionError):  # nested deeper than the reader goes
        return None


def top(block: dict) -> float:
    """The upper edge of a block; 0 where its box doesn't say."""
    box = block.get("block_bbox")
    y = box[1] if isinstance(box, list) and len(box) > 1 else 0
    return float(y) if isinstance(y, int | float) and not isinstance(y, bool) and abs(y) < 1e15 else 0.0


def strip_tags(s: str) -> str:
    return re.sub(r"<[^>]*>", "", re.sub(r"(?s)<!--.*?-->", "", s))


def page_json(name: str, text: str) -> list[dict]:
    """Invoices of an OCR page: its best table under the header its text blocks give."""
    tables, texts = [], []
    for b in blocks_of(load_json(text)):
        content = str(b.get("block_content") or "")
        if "table" in str(b.get("block_label") or "").lower():
            tables += html_tables(content, spans=False)[:1]
        elif (t := squeeze(strip_tags(content))) and t != "0":
            texts.append(t)
    table = best_table(tables)
    made = invoice(name, "doc_parser_json", page_header(texts), table_items(table) if table else [])
    return [made] if made else []


def title(text: str) -> str:
    m = re.search(r"^#{1,2}\s+(.+)$", text, re.M)
    if m:
        return m[1].strip()
    return next((t for t in map(str.strip, text.split("\n")) if t and t[0] not in "#-*|"), "")


def markdown(name: str, text: str) -> list[dict]:
    """Invoices of Markdown: HTML tables, else pipe tables, else text; merged files part by part."""
    if MERGED_NAME.search(name) or len(MERGED_HEAD.findall(text)) > 1:
        made = [m for part in re.split(r"(?m)(?=^#{1,3}\s+)", text) if part.strip() for m in one_markdown(name, part)]
        return [m | {"source_file": f"{name}#part{i}"} for i, m in enumerate(made)]
    return one_markdown(name, text)


def one_markdown(name: str, text: str) -> list[dict]:
    header = text_header(text)
    header["supplier_name"] = header["supplier_name"] or title(text)
    items: list[dict] = []
    for tables in (html_tables(text), pipe_tables(text)):
        table = best_table(tables, LEAST_TABLE_SCORE)
        items = items or (table_items(table) if table else [])
    made = invoice(name, "generic_markdown", header, items or text_items(strip_tags(text)))
    return [made] if made else []


def text_block(name: str, text: str) -> list[dict]:
    """Invoices of pages without tables, or of text files: items of the text, else of bands of blocks."""
    if name.lower().endswith(".json"):
        found = [b for b in blocks_of(load_json(text)) if str(b.get("block_label") or "").lower() in ("text", "paragraph", "title", "list", "")]
        texts = [(top(b), str(b.get("block_content") or "").strip()) for b in found]
        whole = "\n".join(t for _, t in texts if t)
        items = text_items(whole) or block_items([t for t in texts if t[1]])
    else:
        whole, items = text, text_items(text)
    made = invoice(name, "text_block", text_header(whole), items)
    return [made] if made else []


def model_content(name: str, text: str) -> str:
    """What a language model is shown of a file."""
    page = load_json(text) if name.lower().endswith(".json") else None
    if page is None:
        return text
    shown = [strip_tags(str(b.get("block_content") or "")) for b in blocks_of(page)]
    return "\n".join(shown) if shown else json.dumps(page, ensure_ascii=False, indent=2)


def model_answer(answer: str) -> dict | None:
    """The JSON object of an answer: all of it, else a fenced block, else between the outermost braces."""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", answer, re.S)
    braced = answer[answer.find("{") : answer.rfind("}") + 1]
    return next((o for s in (answer, fenced[1] if fenced else "", braced) if isinstance(o := load_json(s), dict)), None)


def model_invoice(name: str, answer: str) -> list[dict]:
    data = model_answer(answer)
    if data is None:
        return []
    num = lambda v: first_number(str(v)) if v not in (None, "") else 0.0
    given = data.get("items")
    given = [i for i in given if isinstance(i, dict) and (i.get("name") or i.get("code"))] if isinstance(given, list) else []
    calc = half_up(sum(num(i.get("total")) for i in given), 2)  # before missing totals are filled
    items = [item(str(i.get("name") or ""), *complete(num(i.get("qty")), num(i.get("unit_price")), num(i.get("total"))), code=str(i.get("code") or "")) for i in given]
    header = {k: str(data.get(k) or "") or ("" if k.endswith("name") else None) for k in ("supplier_name", "customer_name", "invoice_date", "invoice_number", "currency")}
    header["declared_total"] = num(data["declared_total"]) if data.get("declared_total") not in (None, "") else None
    made = invoice(name, "llm_assisted", header, items)
    return [made | {"calc_total": calc}] if made else []

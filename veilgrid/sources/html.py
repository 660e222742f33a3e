"""Interactive elements of HTML pages, and signs of failure on a page."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrid.functions import values as V

INTERACTIVE = ("input", "button", "select", "textarea")
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
COLUMNS = (
    "dom_id", "ext_id", "tag", "type", "autocomplete", "placeholder", "aria_label", "role", "own_label", "for_label",
    "parent_label", "sibling_text", "inner_text", "value",
)


class _Open:
    """An element that is not closed yet, with its text so far."""

    __slots__ = ("tag", "text", "before", "row", "target", "selected")

    def __init__(self, tag: str):
        self.tag, self.text, self.before = tag, [], None
        self.row = self.target = self.selected = None


class _Elements(HTMLParser):
    """Collect the elements of one page; labels are attached at the end of the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack = [_Open("")]
        self.rows: list[dict] = []
        self.labels: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "option" and self.stack[-1].tag == "option":  # its end tag may be left out
            self._close()
        a = {k: v or "" for k, v in reversed(attrs)}
        node = _Open(tag)
        if tag in INTERACTIVE:
            node.row = {
                "dom_id": a.get("id"), "ext_id": a.get("data-ext-id"), "tag": tag, "type": a.get("type"),
                "autocomplete": a.get("autocomplete"), "placeholder": a.get("placeholder"),
                "aria_label": a.get("aria-label"), "role": a.get("role"), "sibling_text": self.stack[-1].before,
                "value": a.get("value") if tag in ("input", "button") else None,
                "_in": [n.target for n in self.stack if n.tag == "label"],
            }
            self.rows.append(node.row)
        elif tag == "label":
            node.target = {"for": a.get("for"), "text": ""}
            self.labels.append(node.target)
        elif tag == "option":
            node.target = {"value": a.get("value"), "selected": "selected" in a}
        if tag not in VOID:
            self.stack.append(node)

    def handle_data(self, data: str) -> None:
        top = self.stack[-1]
        top.text.append(data)
        top.before = data.strip() or top.before

    def handle_endtag(self, tag: str) -> None:
        if any(n.tag == tag for n in self.stack[1:]):
            while self._close() != tag:
                pass

    def _close(self) -> str:
        node = self.stack.pop()
        text, parent = "".join(node.text), self.stack[-1]
        parent.text.append(text)
        parent.before = text.strip() or parent.before
        if node.tag == "label":
            node.target["text"] = text
        elif node.tag == "option":
            owner = next((n for n in reversed(self.stack) if n.tag == "select"), None)
            if owner is not None and (owner.selected is None or node.target["selected"]):
                chosen = node.target["value"]
                owner.selected = text.strip() if chosen is None else chosen
        elif node.tag == "textarea":
            node.row["value"] = text
        elif node.row is not None:
            node.row["inner_text"] = text
            if node.tag == "select":
                node.row["value"] = node.selected
        return node.tag

    def finish(self) -> list[dict]:
        self.close()
        while len(self.stack) > 1:
            self._close()
        for row in self.rows:
            around = row.pop("_in")
            own = [
                label["text"] for label in self.labels
                if (row["dom_id"] and label["for"] == row["dom_id"]) or (label in around and label["for"] is None)
            ]
            row["own_label"] = next((t for t in own if t.strip()), None)
            row["for_label"] = next(
                (x["text"] for x in self.labels if row["dom_id"] and x["for"] == row["dom_id"]), None)
            row["parent_label"] = around[-1]["text"] if around else None
        return self.rows


def html_elements(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """One row per input, button, select and textarea, ready for classification.

    Pages are parsed in the tasks that read them; a page yields its rows alone, so nothing
    is shuffled.
    """
    schema = f"payload_id {pages.schema[page_id].dataType.simpleString()}, seq bigint, " + ", ".join(
        f"{c} string" for c in COLUMNS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch[page_id], batch[html]):
                parser = _Elements()
                parser.feed(text or "")
                for seq, row in enumerate(parser.finish()):
                    rows.append((key, seq, *(row.get(c) for c in COLUMNS)))
            yield pd.DataFrame(rows, columns=["payload_id", "seq", *COLUMNS])

    return pages.select(page_id, html).mapInPandas(run, schema)


class _Notices(HTMLParser):
    """The visible text of one page, and whether an element is marked as an error."""

    INLINE = frozenset("a abbr b bdi bdo cite code em i kbd mark q s small span strong sub sup u var".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.hidden = ""
        self.marked = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in reversed(attrs)}
        classes = a.get("class", "").split()
        self.marked |= a.get("role") == "alert" or a.get("aria-invalid") == "true" or "error" in classes or "alert-danger" in classes
        self.hidden = tag if tag in ("script", "style") else self.hidden
        if tag not in self.INLINE:
            self.text.append(" ")

    def handle_endtag(self, tag: str) -> None:
        self.hidden = "" if tag == self.hidden else self.hidden
        if tag not in self.INLINE:
            self.text.append(" ")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append(data)


def page_failures(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add ``verified`` and ``failure_reason``: error phrases in the visible text, else error elements.

    Text is read as a page shows it: white space folded, nothing from scripts, styles and comments.
    """
    phrases = re.compile("|".join(V.FAILURE_PHRASES))

    @F.pandas_udf("string")
    def reason(column: pd.Series) -> pd.Series:
        out = []
        for text in column:
            page = _Notices()
            page.feed(text or "")
            page.close()
            shown = " ".join("".join(page.text).split()).lower()
            out.append(V.REASON_ERROR_TEXT if phrases.search(shown) else V.REASON_ERROR_ELEMENT if page.marked else None)
        return pd.Series(out, dtype=object)

    return pages.withColumn("failure_reason", reason(html)).withColumn("verified", F.expr("failure_reason is null"))

"""Allow and block rules for URLs, matched by a trie over reversed host labels and path segments.

A rule is ``host/path``: it fits the host and all its subdomains, if the URL's path starts with the rule's path
(``net/es/`` has host ``net`` and path ``/es/``). The rule with the most host labels wins, then the one
with the longest path; of equal rules the first one given wins. A URL that no rule fits gets ``default``.

Defined cases: a null URL, or one without ``://``, has an empty host and path and no rule; an empty path fits
no rule, since each rule's path starts with ``/``; a port or user name is part of the host, as written;
repeated rows are judged each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

MAX_TRIE_BYTES = 256 << 20  # size bound of what is broadcast; more rules than fit are an error
URL = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
UPPER = {c: c + 32 for c in range(65, 91)}


@dataclass
class Node:
    """A trie node: children by host label or path segment; ``ends`` are rules whose path stops inside a segment."""

    children: dict[str, Node] = field(default_factory=dict)
    paths: Node | None = None
    rule: tuple[str, str] | None = None
    ends: dict[str, tuple[str, str]] = field(default_factory=dict)


def build_trie(rules: Sequence[tuple[str, str]]) -> Node:
    """Trie of (verdict, rule) entries."""
    root = Node()
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        if verdict not in ("allow", "block") or not host or not slash:
            raise ValueError(f"not a rule: {verdict} {rule}")
        node = root
        for label in reversed(host.translate(UPPER).split(".")):
            node = node.children.setdefault(label, Node())
        node.paths = node.paths or Node()
        node = node.paths
        *full, rest = path.split("/")
        for segment in full:
            node = node.children.setdefault(segment, Node())
        if rest:
            node.ends.setdefault(rest, (verdict, rule))
        elif node.rule is None:
            node.rule = (verdict, rule)
    return root


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path."""
    found = URL.search(url) if url else None
    return (found[1].translate(UPPER), found[2]) if found else ("", "")


def longest_path(node: Node, path: str) -> tuple[str, str] | None:
    """The rule with the longest path that ``path`` starts with."""
    if not path.startswith("/"):
        return None
    best, segments = node.rule, path[1:].split("/")
    for i, segment in enumerate(segments):
        # A rule may stop inside a segment; the longest such prefix beats what stopped before.
        for size in range(len(segment), 0, -1) if node.ends else ():
            if segment[:size] in node.ends:
                best = node.ends[segment[:size]]
                break
        node = node.children.get(segment) if i + 1 < len(segments) else None
        if node is None:
            break
        best = node.rule or best
    return best


def match(root: Node, host: str, path: str) -> tuple[str, str] | None:
    """The winning (verdict, rule), or None."""
    best, node = None, root
    for label in reversed(host.split(".")):
        node = node.children.get(label)
        if node is None:
            break
        if node.paths is not None:
            best = longest_path(node.paths, path) or best
    return best


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url",
                default: str = "allow") -> DataFrame:
    """One row per page: id, url, host, path, the rule that decides (or null), and the verdict.

    The trie is broadcast once, behind a check of its size. No shuffle; only the two columns are read.
    """
    payload = pickle.dumps(build_trie(rules))
    if len(payload) > MAX_TRIE_BYTES:
        raise ValueError(f"the rules take {len(payload)} bytes; at most {MAX_TRIE_BYTES} are broadcast")
    shared = pages.sparkSession.sparkContext.broadcast(payload)
    narrow = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = pickle.loads(shared.value)
        for batch in batches:
            parts = [split_url(u) for u in batch.column("url").to_pylist()]
            hits = [match(root, *p) for p in parts]
            yield pa.RecordBatch.from_pydict({
                "page_id": batch.column("page_id"), "url": batch.column("url"),
                "host": pa.array([p[0] for p in parts], pa.string()), "path": pa.array([p[1] for p in parts], pa.string()),
                "rule": pa.array([h and h[1] for h in hits], pa.string()),
                "verdict": pa.array([h[0] if h else default for h in hits], pa.string())})

    kind = narrow.dtypes[0][1]
    return narrow.mapInArrow(run, f"page_id {kind}, url string, host string, path string, rule string, verdict string")

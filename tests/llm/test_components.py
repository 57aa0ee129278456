"""Classes of links against union and find, and token counts and archives in odd cases."""

from __future__ import annotations

import base64
import hashlib
import random

from vexil.llm import queries, token_counts, warc
from vexil.llm.components import components


def _classes(links: list[tuple[int, int]]) -> dict[int, int]:
    above: dict[int, int] = {}

    def top(x: int) -> int:
        above.setdefault(x, x)
        while above[x] != x:
            x = above[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        above[max(a, b)] = min(a, b)
    return {x: top(x) for x in above}


def test_classes_of_chains_stars_and_chance(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(200, 260)] + [(0, i) for i in range(300, 360)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)]
    links += [(5, 5), (7, 6), (7, 6), (-3, 6), (9_000_000_000, 8_000_000_000)]
    rng.shuffle(links)
    got = {r["id"]: r["class"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == _classes(links)


def test_no_links_and_links_to_nothing(spark):
    links = spark.createDataFrame([(1, None), (None, 2), (3, 4)], "a long, b long")
    assert components(links.limit(0)).count() == 0
    assert {(r["id"], r["class"]) for r in components(links).collect()} == {(3, 3), (4, 3)}


def test_counts_beside_columns_of_the_same_names(spark):
    import public_tokenizers

    rows = [(1, "two words", 9, 9, True), (None, None, None, None, None), (1, "two words", 9, 9, True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int, n_tokens int, over_limit boolean")
    got = token_counts.token_counts(df, public_tokenizers.path(queries.VOCABULARY)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got), key=str) == sorted([(1, 9, 2, False), (None, 0, 0, False), (1, 9, 2, False)], key=str)


def test_long_and_binary_looking_payloads(spark):
    rng = random.Random(5)
    long = "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(1_500_000))
    pages = [(1, "u", long), (2, "u", long), (3, "u", "\r\n\r\nWARC/1.1\r\n\x00"), (4, "u", "\x1f\x8b" * 1000)]
    got = {r.page_id: r for r in warc.warc_round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i, _, html in pages:
        assert got[i].payload_bytes == len(html.encode()) and got[i].payload_digest == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
    assert {i for i in got if got[i].record_type == "revisit"} == {2} and got[2].refers_to == 1

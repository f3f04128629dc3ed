"""URL filter by a weighted vocabulary.

One Aho-Corasick automaton finds all terms of the vocabulary in a URL's host, path and query in one pass. A
hit counts only if it is a whole word: neither neighbour is a letter or digit. A URL is rejected on any strict
term, or as soon as the weights of its distinct soft terms, of which several are needed, reach the limit. Explicit allow and block rules
for hosts and paths come first; the longest that fits decides.

Defined results: a NULL URL, or one without '://', has empty host and path, no terms and is allowed; each row
is judged alone, so repeated rows get equal verdicts; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Our own vocabulary, from what such addresses are about. Strict terms have no innocent use in an address; a soft term's
# weight says how seldom it is innocent: 1.5 hardly ever, 1 often not, 0.75 and less mostly innocent by itself.
STRICT = (
    "porn porno pornos xxx hentai camgirls sexcam escorts viagra cialis casino casinos onlinecasino pokies "
    "warez keygen payday"
).split()
SOFT = {
    **dict.fromkeys("milf nudes nsfw erotic fetish upskirt".split(), 1.5),
    **dict.fromkeys("jackpot roulette blackjack sportsbook nulled cracked keylogger".split(), 1.5),
    **dict.fromkeys("nude sexy escort webcam betting gambling poker slots bookmaker torrent replica steroids".split(), 1.0),
    **dict.fromkeys("pharmacy meds loan loans credit bonus bet lottery bingo crack hacked cheats backlinks".split(), 0.75),
    **dict.fromkeys("sex dating singles discount coupon deals seo banner popup tracker prizes".split(), 0.5),
}
SOFT_LIMIT = 2.0


@dataclass(frozen=True)
class Rule:
    """Fits ``host``, its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @staticmethod
    def parse(line: str) -> Rule:
        """From, for example, "block example.org/es/"."""
        verdict, _, place = line.partition(" ")
        host, slash, path = place.partition("/")
        return Rule(verdict, host, slash + path)


RULES = tuple(
    map(Rule.parse, ["allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/"])
)
PARTS = re.compile(r"://([^/?#]*)([^?#]*)([^#]*)", re.DOTALL)
CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RESULT = (
    "host string, path string, rule string, verdict string, strict_terms array<string>, "
    "soft_terms array<string>, soft_weight double"
)


class UrlJudge:
    def __init__(self, rules=RULES, strict=STRICT, soft=SOFT, limit=SOFT_LIMIT):
        self.strict, self.soft, self.limit = frozenset(strict), dict(soft), limit
        self.rules: dict[str, list[Rule]] = {}
        for rule in rules:
            self.rules.setdefault(rule.host, []).append(rule)
        self.words = ahocorasick.Automaton()
        for term in sorted(self.strict | self.soft.keys()):
            self.words.add_word(term, term)
        if len(self.words):
            self.words.make_automaton()

    def terms(self, text: str) -> set[str]:
        found = set()
        for end, term in self.words.iter(text) if len(self.words) else ():
            start = end - len(term)
            before, after = text[start : start + 1] if start >= 0 else "", text[end + 1 : end + 2]
            if not (before.isalnum() or after.isalnum()):
                found.add(term)
        return found

    def rule(self, host: str, path: str) -> Rule | None:
        """The longest rule that fits: every suffix of the host's labels is looked up."""
        labels, fits = host.split("."), []
        for i in range(len(labels)):
            fits += [r for r in self.rules.get(".".join(labels[i:]), ()) if path.startswith(r.path)]
        return max(fits, key=lambda r: (len(r.host + r.path), r.verdict), default=None)

    def judge(self, url: str | None) -> tuple:
        match = PARTS.search(url or "")
        host, path, query = match.groups() if match else ("", "", "")
        host = host.translate(CAPITALS)
        terms = self.terms(unquote(f"{host}{path}{query}").lower()) if match else set()
        strict, soft = sorted(terms & self.strict), sorted(terms & self.soft.keys())
        weight = sum(self.soft[t] for t in soft)
        rule = self.rule(host, path)
        bad = bool(strict) or weight >= self.limit
        verdict = rule.verdict if rule else "block" if bad else "allow"
        return host, path, rule and rule.host + rule.path, verdict, strict, soft, float(weight)


def judge_urls(pages: DataFrame, key: str = "page_id", **options) -> DataFrame:
    """The key column and the verdict of each row's url; options as for ``UrlJudge``. No shuffle."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = UrlJudge(**options)
        names = [x.split()[0] for x in RESULT.split(", ")]
        types = [pa.string()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64()]
        for batch in batches:
            rows = [judge.judge(url) for url in batch["url"].to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch[key], *arrays], names=[key, *names])

    return pages.select(key, F.col("url").cast("string").alias("url")).mapInArrow(run, f"{key} {kind}, {RESULT}")

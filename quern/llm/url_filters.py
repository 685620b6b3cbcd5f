"""URL filters: pattern rules indexed by their rarest literal token.

A pattern is written in a small filter language over the whole URL with A-Z lower-cased:
``*`` stands for any characters, ``^`` for one character that is no letter or digit (or the
end), ``||`` at the start for the beginning of the host or of one of its labels, ``|`` at
either end for that end. A leading ``@@`` makes it an exception.

A host rule (``example.net/en/``) fits its host and all subdomains if the path starts with
the rule's path; of several that fit the longest wins and decides. Without one the patterns
decide: block if a pattern fits and no exception does, else allow.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quern.llm._spark import checkpointed, map_batches

#: Characters of rules in one index; longer lists are applied in several passes.
INDEX_CHARS = 8 << 20

#: Host rules, with their actions. Fixed values.
HOST_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}

#: Patterns used where no host rule fits: gambling, adult and spam hosts, downloads, tracking paths.
PATTERNS = (
    "||casino^", "||poker^", "||betting^", "||jackpot^", "||slots^", "||porn^", "||xxx^", "||adult^", "||viagra^", "||pills^",
    "||free-money^", "||torrent^", "||warez^", "||malware^", "||phishing^", "||ads^", "||adserver^", "||tracker^",
    "/wp-login.php", "/adclick^", "^popup^*^ad^", "*.exe|", "*.zip|",
    "@@||help.*^responsible-gaming^", "@@||research.*^casino^",
)

_TOKEN = re.compile("[a-z0-9]+")
_TO_LOWER = {c: c + 32 for c in range(65, 91)}
_PARTS = re.compile(r"(?s).*?://([^/?#]*)([^?#]*)")


def pattern_regex(pattern: str, end: str = r"\Z") -> str:
    """The regular expression of a pattern (searched, not anchored); ``end`` is how the engine spells the end of the text."""
    body = pattern.removeprefix("@@")
    head = "://([^/?#]*[.@-])?" if body.startswith("||") else "^" if body.startswith("|") else ""
    body = body.lstrip("|")
    tail = end if body.endswith("|") else ""
    spelled = {"*": ".*", "^": f"([^a-z0-9]|{end})"}
    return head + "".join(spelled.get(c) or re.escape(c) for c in body.rstrip("|")) + tail


def host_regex(rule: str) -> str:
    """The regular expression of a host rule over host and path put together."""
    return "^([^/]*[.])?" + re.escape(rule)


def literal_tokens(pattern: str) -> list[str]:
    """Runs of letters and digits that every matching URL has as whole runs of its own.

    A run at an open end or next to ``*`` could be part of a longer one and doesn't count.
    """
    body = pattern.removeprefix("@@")
    closed = body.startswith("|"), body.endswith("|")
    body = body.strip("|")
    found = []
    for m in _TOKEN.finditer(body):
        before = body[m.start() - 1] != "*" if m.start() else closed[0]
        after = body[m.end()] != "*" if m.end() < len(body) else closed[1]
        if before and after:
            found.append(m[0])
    return found


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path; both empty for null or a text without ``://``."""
    m = _PARTS.match(url) if url else None
    return (m[1].translate(_TO_LOWER), m[2]) if m else ("", "")


class Index:
    """Rules by their rarest token; rules without one are in ``always``."""

    def __init__(self, hosts: Sequence[tuple[str, str]], patterns: Sequence[str], counts: dict[str, int]):
        self.by_token, self.always = defaultdict(list), []
        for rule, action in hosts:
            tokens = _TOKEN.findall(rule.partition("/")[0].translate(_TO_LOWER))
            self._add(tokens, counts, (rule, action, re.compile(host_regex(rule), re.S)))
        for p in patterns:
            self._add(literal_tokens(p), counts, (None, "allow" if p.startswith("@@") else "block", re.compile(pattern_regex(p), re.S)))

    def _add(self, tokens, counts, entry) -> None:
        if tokens:
            self.by_token[min(tokens, key=lambda t: (counts.get(t, 0), -len(t), t))].append(entry)
        else:
            self.always.append(entry)

    def judge(self, url: str, host: str, path: str):
        """The longest fitting host rule with its action, and whether a pattern and an exception fit."""
        lower, place = url.translate(_TO_LOWER), host + path
        rule = action = None
        blocked = excepted = False
        for entries in (self.always, *filter(None, map(self.by_token.get, set(_TOKEN.findall(lower))))):
            for name, what, fits in entries:
                if name is not None:
                    if (rule is None or len(name) > len(rule)) and fits.search(place):
                        rule, action = name, what
                elif what == "block":
                    blocked = blocked or bool(fits.search(lower))
                else:
                    excepted = excepted or bool(fits.search(lower))
        return rule, action, blocked, excepted


def _blocks(hosts: dict[str, str], patterns: Sequence[str]) -> list[tuple[list, list]]:
    out, size = [([], [])], 0
    for kind, rule, text in [*((0, r, r[0]) for r in hosts.items()), *((1, p, p) for p in patterns)]:
        if size + len(text) > INDEX_CHARS and size:
            out.append(([], []))
            size = 0
        out[-1][kind].append(rule)
        size += len(text)
    return out


def token_frequencies(pages: DataFrame, tokens: set[str]) -> dict[str, int]:
    """In how many URLs each of the rules' tokens occurs, over all rows.

    Counted per batch, then summed by token; what comes back has one row per rule token.
    """
    wanted = frozenset(tokens)

    def work():
        def each(batch):
            n: dict[str, int] = defaultdict(int)
            for url in batch.column(0).to_pylist():
                for t in wanted.intersection(_TOKEN.findall((url or "").translate(_TO_LOWER))):
                    n[t] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["token", "n"])

        return each

    counted = map_batches(pages.select("url"), work, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r["token"]: r["n"] for r in counted.collect()}


def judge_urls(pages: DataFrame, hosts: dict[str, str] = HOST_RULES, patterns: Sequence[str] = PATTERNS) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url).

    No shuffle: the index travels to the rows. Rule lists above ``INDEX_CHARS`` are applied
    in several passes, each with an index of that size, carrying the best rule along. A null
    url has an empty host and path and no rule; it is allowed unless a pattern fits ''.
    """
    wanted = {t for p in patterns for t in literal_tokens(p)} | {t for h in hosts for t in _TOKEN.findall(h.partition("/")[0])}
    counts = token_frequencies(pages, wanted)
    state = "page_id long, url string, rule string, action string, blocked boolean, excepted boolean"
    df = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", *(F.lit(None).cast(k).alias(c) for c, k in (("rule", "string"), ("action", "string"), ("blocked", "boolean"), ("excepted", "boolean"))))
    passes = _blocks(hosts, patterns)
    for k, (h, p) in enumerate(passes):
        last = k == len(passes) - 1
        kept = {t: counts.get(t, 0) for t in {t for x in p for t in literal_tokens(x)} | {t for x, _ in h for t in _TOKEN.findall(x.partition("/")[0])}}
        sent = df.sparkSession.sparkContext.broadcast((h, p, kept))
        schema = "page_id long, host string, path string, rule string, verdict string" if last else state
        judged = map_batches(df, lambda sent=sent, last=last: _pass(sent, last), schema)
        # a pass of its own, so that a task holds one index in one worker
        df = judged if last else checkpointed(judged)
    return df


def _pass(sent, last: bool):
    index = Index(*sent.value)

    def each(batch):
        urls = batch.column(1).to_pylist()
        rules, actions, blocked, excepted, hosts, paths = [], [], [], [], [], []
        for url, rule, action, b, e in zip(urls, *(batch.column(i).to_pylist() for i in range(2, 6))):
            host, path = split_url(url)
            r, a, b2, e2 = index.judge(url or "", host, path)
            if r is not None and (rule is None or len(r) > len(rule)):
                rule, action = r, a
            for column, v in ((rules, rule), (actions, action), (blocked, bool(b) or b2), (excepted, bool(e) or e2), (hosts, host), (paths, path)):
                column.append(v)
        s, flag = pa.string(), pa.bool_()
        if last:
            verdicts = [a or ("block" if b and not e else "allow") for a, b, e in zip(actions, blocked, excepted)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, s) for x in (hosts, paths, rules, verdicts))], ["page_id", "host", "path", "rule", "verdict"])
        else:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(urls, s), pa.array(rules, s), pa.array(actions, s), pa.array(blocked, flag), pa.array(excepted, flag)],
                ["page_id", "url", "rule", "action", "blocked", "excepted"],
            )

    return each


def sql() -> str:
    """DuckDB SQL for ``judge_urls`` over ``pages``, with the rules above and without an index."""
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    longest = sorted(HOST_RULES, key=len, reverse=True)
    rule = " ".join(f"WHEN regexp_matches(host || path, {quoted(host_regex(r))}, 's') THEN {quoted(r)}" for r in longest)
    action = " ".join(f"WHEN {quoted(r)} THEN {quoted(a)}" for r, a in HOST_RULES.items())
    fits = [" OR ".join(f"regexp_matches(u, {quoted(pattern_regex(p, '$'))}, 's')" for p in PATTERNS if p.startswith("@@") == e) for e in (False, True)]
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(url, ''), '{upper}', '{lower}') AS u,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{upper}', '{lower}') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
ruled AS (SELECT *, CASE {rule} END AS rule FROM parts)
SELECT page_id, host, path, rule,
       coalesce(CASE rule {action} END, CASE WHEN ({fits[0]}) AND NOT ({fits[1]}) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled"""

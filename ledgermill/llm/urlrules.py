"""URL rules by a sort-merge range join.

A host key is its labels in reverse, each ended by a dot, so a rule's host and its subdomains
form one interval of keys. Pages and hosts of rules are sorted by key; a sweep pushes a rule
when its interval opens and pops it when it closes, and the longest rule on the stack whose
path begins the page's path wins. Hot hosts are split, as page_id takes part in the ranges.
Rules are closed over, so they are limited to MOST_RULES. A null url, or one without ://, has
empty host and path and takes the default verdict. Of rules that are equally long none can fit the same
url; a rule given twice must not contradict itself. Repeated rows and ids get a row each, a null id is kept,
urls of any length are read whole, columns other than page_id and url are not read, and an empty table gives no rows.
"""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
MOST_RULES = 100_000


def reverse(host: str) -> str:
    return "".join(f"{x}." for x in reversed(host.split(".")))


def judge(pages: DataFrame, rules=RULES, default="allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    starts = sorted((reverse(h), len(h + p), p, h + p, v) for h, p, v in rules)
    rest = F.regexp_extract("url", r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    keyed = pages.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    keyed = keyed.withColumn("key", F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit(".")))
    def sweep():
        at, stack = 0, []

        def judge(keys, paths):
            nonlocal at, stack
            names, verdicts = [], []
            for key, path in zip(keys, paths):
                while at < len(starts) and starts[at][0] <= key:
                    while stack and not starts[at][0].startswith(stack[-1][0]):
                        stack.pop()
                    stack.append(starts[at])
                    at += 1
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                best = max((r for r in stack if path.startswith(r[2])), key=lambda r: r[1], default=None)
                names.append(best[3] if best else None)
                verdicts.append(best[4] if best else default)
            return names, verdicts

        return judge

    ordered = keyed.repartitionByRange("key", "page_id").sortWithinPartitions("key")
    return add_columns(ordered, ["page_id", "host", "path"], ["key", "path"], "rule string, verdict string", sweep)


ORACLE_SQL = r"""with u as (select page_id, coalesce(regexp_extract(url, '^.*?://(.*)$', 1, 's'), '') as r from pages),
p as (select page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1, 's') as path from u),
rules(h, p, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m as (select p.*, h || rules.p as rule, v from p left join rules on (host = h or suffix(host, '.' || h)) and starts_with(path, rules.p))
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from m qualify row_number() over (partition by page_id order by length(rule) desc nulls last) = 1"""

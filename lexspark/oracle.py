"""DuckDB SQL for searches: the same matches and scores, from the tables alone."""

from __future__ import annotations

from collections.abc import Iterable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def standard(column: str) -> str:
    return f"regexp_extract_all(translate({column}, '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"


def keyword(column: str) -> str:
    return f"case when {column} = '' then [] else [{column}] end"


def tokens(docs: str, fields: dict[str, str]) -> str:
    """CTEs docs, toks, lens, tok and fs; ``fields``: name to a SQL list of terms, null where absent."""
    each = " union all ".join(f"select doc_id, '{name}' as field, {terms} as t from docs" for name, terms in fields.items())
    return f"""with docs as materialized ({docs}),
toks as materialized (select * from ({each}) where t is not null),
lens as (select doc_id, field, len(t)::int as dl from toks),
tok as materialized (select doc_id, field, unnest(t) as term, (generate_subscripts(t, 1) - 1)::int as pos from toks),
fs as (select field, count(*) as n_docs, sum(dl)::bigint as total_len, sum(dl)::double / count(*)::double as avg_len from lens group by field)"""


def T(field: str, term: str, boost: float = 1.0) -> tuple:
    return ("t", field, term, boost)


def P(field: str, words: Iterable[tuple[str, int]], boost: float = 1.0) -> tuple:
    return ("p", field, tuple(words), boost)


def A(*parts) -> tuple:
    return ("and", *parts)


def O(*parts) -> tuple:  # noqa: E743
    return ("or", *parts)


def N(part) -> tuple:
    return ("not", part)


def R(condition: str) -> tuple:
    return ("range", condition)


M = ("all",)


def hits(base: str, tree: tuple, k1: float = 1.2, b: float = 0.75) -> str:
    """``base`` with a CTE hits(doc_id, score)."""
    ctes: list[str] = []
    scores: dict[tuple, str] = {}

    def score_cte(field: str, term: str) -> str:
        key = (field, term)
        if key not in scores:
            name = scores[key] = f"s{len(scores)}"
            literal = term.replace("'", "''")
            ctes.append(
                f"{name} as (select c.doc_id, ln(1e0 + (fs.n_docs - d.df + 0.5e0) / (d.df + 0.5e0)) * (c.tf * {k1 + 1!r}e0 / (c.tf + {k1!r}e0 * ({1 - b!r}e0 + {b!r}e0 * lens.dl::double / fs.avg_len))) as s "
                f"from (select doc_id, count(*)::double as tf from tok where field = '{field}' and term = '{literal}' group by doc_id) c "
                f"join lens on lens.doc_id = c.doc_id and lens.field = '{field}' join fs on fs.field = '{field}' "
                f"cross join (select count(distinct doc_id)::double as df from tok where field = '{field}' and term = '{literal}') d)"
            )
        return scores[key]

    phrases: list[str] = []

    def of(node: tuple) -> tuple[str, str]:
        kind = node[0]
        if kind == "t":
            name = score_cte(node[1], node[2])
            return f"{name}.s is not null", f"coalesce({name}.s * {node[3]!r}::double, 0e0)"
        if kind == "p":
            _, field, words, boost = node
            name = f"p{len(phrases)}"
            phrases.append(name)
            names = [score_cte(field, w) for w, _ in words]
            literals = [w.replace("'", "''") for w, _ in words]
            joins = "".join(f" join tok t{k} on t{k}.doc_id = t0.doc_id and t{k}.field = '{field}' and t{k}.term = '{literals[k]}' and t{k}.pos = t0.pos + {at - words[0][1]}" for k, (_, at) in enumerate(words) if k)
            ctes.append(f"{name} as (select distinct t0.doc_id from tok t0{joins} where t0.field = '{field}' and t0.term = '{literals[0]}')")
            matched = f"{name}.doc_id is not null"
            return matched, f"case when {matched} then " + " + ".join(f"{n}.s * {boost!r}::double" for n in names) + " else 0e0 end"
        if kind in ("and", "or"):
            parts = [of(p) for p in node[1:]]
            if not parts:
                return "false", "0e0"
            matched = "(" + f" {kind} ".join(m for m, _ in parts) + ")"
            return matched, f"case when {matched} then " + " + ".join(s for _, s in parts) + " else 0e0 end"
        if kind == "not":
            return f"(not {of(node[1])[0]})", "0e0"
        if kind == "range":
            return f"coalesce({node[1]}, false)", "0e0"
        return "true", "0e0"

    matched, score = of(tree)
    joins = "".join(f" left join {n} on {n}.doc_id = docs.doc_id" for n in (*scores.values(), *phrases))
    extra = "".join(f",\n{c}" for c in ctes)
    return f"{base}{extra},\nhits as (select docs.doc_id, round({score}, 9) as score from docs{joins} where {matched})"

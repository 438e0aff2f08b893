"""Small builders for the plain-SQL counterparts of the queries.

They spell the same questions for a single-node SQL engine: windows over whole
captures, which are fine there and keep the two sides independent.
"""

from __future__ import annotations

from capsift.plans.views import with_views

NL = "chr(10)"


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def cut(x: str, width: int) -> str:
    return f"case when length({x}) <= {width} then {x} else substring({x}, 1, {width - 3}) || '...' end"


def tokens(x: str) -> str:
    return f"cast(ceil(length({x}) / 4.0) as bigint)"


def share(saved: str, raw: str) -> str:
    return f"cast(case when {raw} > 0 then floor(cast({saved} as double) / {raw} * 100 + 0.5) else 0 end as bigint)"


def template(x: str) -> str:
    """A log line's template; ``\\b`` is ASCII in this dialect."""
    steps = ((r"^\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}[.,]?\d*\s*", ""),
             (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<UUID>"),
             (r"0x[0-9a-fA-F]+", "<HEX>"), (r"\b\d{4,}\b", "<NUM>"), (r"/[\w./\-]+", "<PATH>"))
    for pattern, mark in steps:
        x = f"regexp_replace({x}, '{pattern}', '{mark}', 'g')"
    return trimmed(x)


def severity(x: str) -> str:
    low = f"lower({x})"
    return (f"case when contains({low}, 'error') or contains({low}, 'fatal') or contains({low}, 'panic') then 'error' "
            f"when contains({low}, 'warn') then 'warn' when contains({low}, 'info') then 'info' end")


def tally(source: str, keys: str, text: str = "line") -> str:
    """Distinct texts with rank, repeats and totals; columns r, n, total, n_distinct."""
    return (f"select *, row_number() over (partition by {keys} order by line_no, {text}) as r, "
            f"sum(n) over (partition by {keys}) as total, count(*) over (partition by {keys}) as n_distinct, "
            f"min(line_no) over (partition by {keys}) as first_line_no from (select {keys}, {text}, count(*) as n, min(line_no) as line_no from {source} group by {keys}, {text})")


def ranked(source: str, keys: str, order: str = "line_no") -> str:
    """Rows with rank ``r`` and group size ``total``."""
    return (f"select *, row_number() over (partition by {keys} order by {order}) as r, "
            f"count(*) over (partition by {keys}) as total from {source}")


def query(views: str | tuple[str, ...], *steps: tuple[str, str], final: str) -> str:
    """Views, named steps and the final SELECT as one statement."""
    names = (views,) if isinstance(views, str) else views
    head = with_views(*names) if names else "with "
    body = ",\n".join(f"{name} as (\n{sql})" for name, sql in steps)
    return head + (",\n" if names and body else "") + body + "\n" + final


#: generic cut of a line table ``src``: needs a step named ``src`` (capture_id, line_no, line)
def generic_steps(src: str, prefix: str = "") -> list[tuple[str, str]]:
    return [
        ("sizes", f"select capture_id, count(*) as n_lines from {src} group by capture_id"),
        ("short", f"select s.*, row_number() over (partition by capture_id order by line_no) as r from {src} s"),
        ("uniq", f"select *, row_number() over (partition by capture_id order by line_no) as r, "
                 f"count(*) over (partition by capture_id) as n from (select capture_id, line, min(line_no) as line_no "
                 f"from {src} where {trimmed('line')} <> '' group by capture_id, line)"),
        ("generic", f"""select capture_id, '{prefix}pass' as section, r as rank, line, n_lines as total
from short join sizes using (capture_id) where n_lines <= 40
union all
select capture_id, '{prefix}' || case when n <= 40 then 'distinct' when r <= 20 then 'head' else 'tail' end, r, line, n
from uniq join sizes using (capture_id) where n_lines > 40 and (n <= 40 or r <= 20 or r > n - 10)"""),
    ]

"""SQL that restates queries of the training-data operators, where SQL can express them: name -> statement for DuckDB."""

from __future__ import annotations

import unicodedata

#: Characters that compatibility decomposition turns into one letter or digit, and the ligatures that it takes apart; DuckDB has no such form.
_SINGLE = [(chr(c), d) for c in range(0x80, 0x10000) if len(d := unicodedata.normalize("NFKD", chr(c))) == 1 and d != chr(c) and d.isalnum() and d.isascii()]
_LIGATURES = [(chr(c), unicodedata.normalize("NFKD", chr(c))) for c in range(0xFB00, 0xFB07)]


def _compatible(text: str) -> str:
    for ligature, letters in _LIGATURES:
        text = f"replace({text}, '{ligature}', '{letters}')"
    return f"translate({text}, '{''.join(a for a, _ in _SINGLE)}', '{''.join(b for _, b in _SINGLE)}')"


#: The words of a text: invisible characters and combining marks deleted, lower case, maximal runs of letters and digits.
_WORDS = (
    r"regexp_extract_all(lower(strip_accents(regexp_replace("
    + _compatible("text")
    + r", '[\x{AD}\x{200B}-\x{200D}\x{2060}\x{FEFF}]', '', 'g'))), '[\p{L}\p{N}]+')"
)


def _runs(table: str, key: str, size: int) -> str:
    """Distinct runs of ``size`` successive words of every row of ``table`` (key, w)."""
    return f"""select distinct {key}, array_to_string(w[i : i + {size - 1}], ' ') as run
        from (select {key}, w, unnest(range(1, len(w) - {size - 2})) as i from {table} where len(w) >= {size})"""


P4_FOUND = f"""
with texts as (
    select 'fineweb' as source_table, row_id, text from fineweb where text is not null
    union all
    select 'nemotron_post_training', row_id,
        array_to_string(list_transform(list_filter(messages, lambda m: m is not null and m.content is not null and coalesce(m.role, '') <> 'system'), lambda m: m.content), chr(10))
    from nemotron_post_training where messages is not null
),
worded as (select source_table, row_id, {_WORDS} as w from texts),
taking_part as (select source_table, row_id, w from worded where len(w) >= 20),
runs as ({_runs('taking_part', 'source_table, row_id', 3)}),
sizes as (select source_table, row_id, count(*) as n from runs group by all),
shared as (
    select a.source_table, a.row_id as row_id_a, b.row_id as row_id_b, count(*) as n
    from runs a join runs b on a.source_table = b.source_table and a.run = b.run and a.row_id < b.row_id
    group by all
)
select s.source_table, s.row_id_a, s.row_id_b
from shared s
join sizes x on x.source_table = s.source_table and x.row_id = s.row_id_a
join sizes y on y.source_table = s.source_table and y.row_id = s.row_id_b
where 2 * s.n >= x.n + y.n - s.n
"""

P6_FOUND = f"""
with d as (select doc_id, {_WORDS} as w from documents where text is not null),
e as (select item_id, {_WORDS} as w from eval_items where text is not null),
d_runs as ({_runs('d', 'doc_id', 13)}),
e_runs as ({_runs('e', 'item_id', 13)})
select distinct doc_id, item_id from d_runs join e_runs using (run)
"""

ORACLES = {"p4_found": P4_FOUND, "p6_found": P6_FOUND}

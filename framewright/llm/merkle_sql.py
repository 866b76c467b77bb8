"""The Merkle manifest in DuckDB SQL: recursion over levels, up for the nodes and again up for the proofs."""

from __future__ import annotations

_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def _leaf(changed: dict[str, str]) -> str:
    def field(column: str) -> str:
        text = f"cast({changed.get(column, column)} as varchar)"
        return f"coalesce(strlen({text})::varchar || ':' || {text}, '-')"

    return f"sha256({' || '.join(map(field, _COLUMNS))})"


#: CRC-32 of a decimal number: bit by bit over its digits.
_CRC32 = (
    "xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ord(c)::ubigint)), "
    "lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::ubigint, 0, 0, 0, 0, 0, 0, 0]), "
    "lambda x, unused: case when x & 1 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end)), 4294967295::ubigint)"
)


def _tree(name: str, nodes: str) -> str:
    """CTEs over nodes (tree, pos, node): every level, and every first node's way up: siblings, left to right, and whether they stand left."""
    return f"""
{name}_levels as (
  select 0 as level, tree, pos, node, count(*) over (partition by tree) as n from {nodes}
  union all
  select any_value(level) + 1, tree, pos // 2, sha256(string_agg(node, '' order by pos)), (any_value(n) + 1) // 2
  from {name}_levels where n > 1 group by tree, pos // 2
), {name}_way as (
  select tree, pos as leaf_pos, pos, 0 as level, cast([] as varchar[]) as nodes, cast([] as boolean[]) as lefts from {nodes}
  union all
  select w.tree, leaf_pos, w.pos // 2, w.level + 1, list_append(nodes, coalesce(s.node, '')), list_append(lefts, w.pos % 2 = 1)
  from {name}_way w join {name}_levels own on own.tree = w.tree and own.level = w.level and own.pos = w.pos and own.n > 1
  left join {name}_levels s on s.tree = w.tree and s.level = w.level and s.pos = xor(w.pos, 1)
), {name}_top as (
  select tree, node from {name}_levels where n = 1
), {name}_path as (
  select tree, leaf_pos, arg_max(nodes, level) as nodes, arg_max(lefts, level) as lefts from {name}_way group by tree, leaf_pos
)"""


def duckdb_sql() -> str:
    """The SQL of op11_merkle."""
    return f"""
with recursive told as (
  select doc_id, lang, {_leaf({})} as leaf, case when {_CRC32} % 7 = 0 then {_leaf({"n_chars": "n_chars + 1"})} end as altered from documents
), leaves as (
  select coalesce('=' || lang, '') as tree, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, leaf as node, doc_id, altered from told
), {_tree("t", "leaves")}, subroots as (
  select '' as tree, row_number() over (order by tree) - 1 as pos, node, tree as lang from t_top
), {_tree("f", "subroots")}, rows as (
  select l.doc_id, l.node as leaf, s.node as subroot, top.node as root, list_concat(p.nodes, q.nodes) as nodes, list_concat(p.lefts, q.lefts) as lefts, coalesce(l.altered, l.node) as shown
  from leaves l join t_path p on p.tree = l.tree and p.leaf_pos = l.pos join subroots s on s.lang = l.tree join f_path q on q.leaf_pos = s.pos cross join f_top top
), folded as (
  select *, list_reduce(list_prepend(shown, list_transform(list_zip(nodes, lefts), lambda z: case when z[2] then 'L' else 'R' end || z[1])),
    lambda own, s: sha256(case when s[1] = 'L' then s[2:] || own else own || s[2:] end)) as folded_root from rows
)
select doc_id, leaf, subroot, root, sha256(array_to_string(nodes, '')) as proof_sha256, folded_root, folded_root = root as verified from folded
"""

"""DuckDB SQL of the operators whose statements are long: the same results by plain means."""

from __future__ import annotations

_CRC_POLYNOMIAL = 0xEDB88320  # fixed: CRC-32, bits in reverse


def crc32_sql(text: str) -> str:
    """CRC-32 of a short ASCII text: a byte comes in, then eight shifts (marked -1)."""
    codes = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = (
        f"case when x >= 0 then xor(acc, x) when acc & 1 = 1 then xor(acc >> 1, {_CRC_POLYNOMIAL}::bigint) else acc >> 1 end"
    )
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {codes}), lambda acc, x: {step}), 4294967295::bigint)"


def merkle_sql(levels: int = 8, top_levels: int = 6) -> str:
    """The manifest for sources of up to 16 ** levels documents and 16 ** top_levels sources, level by level."""

    def enc(value: str) -> str:
        return f"coalesce(strlen({value}::varchar)::varchar || ':' || {value}::varchar, '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join([*(enc(c) for c in ('doc_id', 'source', 'lang', 'n_chars')), enc(text)])})"

    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"""base as (
            select doc_id, coalesce('s' || source, 'n') as source, {leaf('text')} as leaf,
                   case when {crc32_sql('doc_id::varchar')} % 5 = 0 then {leaf(low)} else {leaf('text')} end as held
            from documents)""",
        """placed as (
            select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as place from base)""",
        "s0 as (select source as tree, place as idx, leaf as d from placed)",
    ]

    def build(name: str, last: int) -> None:
        for k in range(last):
            parts.append(
                f"""{name}{k + 1} as (
                select tree, idx // 16 as idx, sha256(string_agg(d, '' order by idx)) as d, list(d order by idx) as kids
                from {name}{k} where tree in (select tree from {name}{k} group by tree having count(*) > 1)
                group by tree, idx // 16)"""
            )
        union = " union all ".join(f"select tree, {k} as level, idx, d from {name}{k}" for k in range(last + 1))
        parts.append(f"{name}_root as (select tree, arg_max(d, level) as d from ({union}) group by tree)")

    def climb(name: str, last: int, start: str) -> str:
        """Adds to each row the siblings met and the digest folded on the way up."""
        rows = start
        for k in range(last):
            side = f"(select tree, idx, kids from {name}{k + 1})"
            spot = f"(w.{name}_at // {16 ** k} % 16)"
            left = f"array_to_string(kids[1:{spot}], '')"
            right = f"array_to_string(kids[{spot} + 2:], '')"
            parts.append(
                f"""{name}_up{k + 1} as (
                select w.* replace (w.proof || case when kids is null then '' else {left} || {right} end as proof,
                       case when kids is null then w.fold else sha256({left} || w.fold || {right}) end as fold)
                from {rows} w left join {side} p on p.tree = w.{name}_tree and p.idx = w.{name}_at // {16 ** (k + 1)})"""
            )
            rows = f"{name}_up{k + 1}"
        return rows

    build("s", levels)
    parts.append("t0 as (select 0 as tree, row_number() over (order by encode(tree)) - 1 as idx, d, tree as source from s_root)")
    build("t", top_levels)
    parts.append(
        """start as (
        select doc_id, leaf, held as fold, '' as proof, p.source as s_tree, place as s_at, 0 as t_tree, t0.idx as t_at, t0.d as subroot
        from placed p join t0 on t0.source = p.source)"""
    )
    rows = climb("t", top_levels, climb("s", levels, "start"))
    return f"""with {', '.join(parts)}
        select doc_id, leaf, subroot, r.d as root, sha256(proof) as proof_sha256, fold as folded_root, fold = r.d as verified
        from {rows} cross join t_root r"""


#: Turns are ordered by turn (null first), ties by the turn's own digest; rows of no conversation are left out.
TRIE_SQL = f"""
    with raw as (
        select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
    own as (
        select conv_id, strlen(role)::varchar || ':' || role || text as word, strlen(text) as bytes,
               row_number() over (partition by conv_id order by turn nulls first, sha256(strlen(role)::varchar || ':' || role || text)) as p
        from raw),
    conv as (
        select conv_id, conv_id - conv_id % 5 as base, {crc32_sql("conv_id::varchar")} % 9 as h, count(*) as n
        from own group by conv_id),
    sized as (
        select c.*, least(c.h, coalesce(b.n, 0)) as k, least(c.h, coalesce(b.n, 0)) + greatest(c.n - c.h, 0) as m
        from conv c left join conv b on b.conv_id = c.base),
    rebuilt as (
        select c.conv_id, o.p as depth, word, bytes, m from sized c join own o on o.conv_id = c.base and o.p <= c.k
        union all
        select c.conv_id, o.p - c.h + c.k, word, bytes, m from sized c join own o on o.conv_id = c.conv_id and o.p > c.h),
    pathed as (
        select conv_id, depth, bytes, m,
               sha256(string_agg(strlen(word)::varchar || ':' || word, '') over (partition by conv_id order by depth)) as prefix
        from rebuilt
        union all
        select conv_id, 0, 0, m, 'root' from sized),
    linked as (
        select a.*, b.prefix as above from pathed a left join pathed b on b.conv_id = a.conv_id and b.depth = a.depth - 1),
    node as (
        select depth, prefix, any_value(above) as above, min(conv_id) as conv_id, count(*) as n_convs,
               any_value(bytes) as bytes,
               sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (depth = m), '')) as ends_sha256
        from linked group by depth, prefix),
    family as (
        select p.depth, p.prefix, count(c.prefix) as n_children
        from node p left join node c on c.above = p.prefix and c.depth = p.depth + 1 group by p.depth, p.prefix),
    full_node as (select n.*, f.n_children from node n join family f using (depth, prefix)),
    subtree as (
        select w.depth, w.prefix, count(*) filter (u.n_children = 0) as n_leaves, sum((u.n_convs - 1) * u.bytes) as saved_tokens
        from full_node u join pathed w on w.conv_id = u.conv_id and w.depth <= u.depth group by w.depth, w.prefix)
    select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children, s.n_leaves,
           s.saved_tokens::bigint as saved_tokens, n.ends_sha256
    from full_node n join subtree s using (depth, prefix)
    left join full_node p on p.depth = n.depth - 1 and p.prefix = n.above"""

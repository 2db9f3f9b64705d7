"""DuckDB SQL beside the queries: named common table expressions, joined as a query needs them."""

from __future__ import annotations

import re

from ..functions.schemas import FIELDS
from ..operators.sampling import MARGINS
from ..sources import adapter

INTEGERS = {kind: tuple(c for c, t in FIELDS[kind].items() if t is int) for kind in ("artist", "album", "track", "user", "le")}
TEXTS = {"artist": ("artist_name",), "album": ("album_name",), "track": ("track_name",), "user": ("country", "gender"), "le": ()}
RAW = {"artist": "artists_raw", "album": "albums_raw", "track": "tracks_raw", "user": "users_raw", "le": "les_raw"}


def integer(column: str) -> str:
    return f"case when regexp_full_match(trim(\"{column}\"), '[+-]?[0-9]+') then try_cast(trim(\"{column}\") as bigint) end"


def draw(*parts: str, seed: int) -> str:
    text = " || ':' || ".join([f"'{seed}'", *[f"cast({p} as varchar)" for p in parts]])
    return f"cast('0x' || substr(md5({text}), 1, 8) as bigint)"


CTES: dict[str, str] = {name: adapter.duckdb_sql(name) for name in adapter.SQL}
for kind, raw in RAW.items():
    ints = ", ".join(f'{integer(c)} as "{c}"' for c in INTEGERS[kind])
    CTES[f"{kind}_all"] = f"select {', '.join([ints, *TEXTS[kind]])} from {raw}"
    CTES[f"{kind}_t"] = f"select * from {kind}_all where " + " and ".join(f'"{c}" is not null' for c in INTEGERS[kind])
for kind in ("artist", "album", "track"):
    CTES[f"{kind}_unnamed"] = (
        f"select distinct {kind}_id from {kind}_t where {kind}_name is null or {kind}_name in ('nan', '{kind}_name')"
    )
    CTES[f"{kind}_n"] = f"select * from {kind}_t where {kind}_id not in (select {kind}_id from {kind}_unnamed)"
    CTES[f"{kind}_c"] = f"select * from {kind}_n where artist_id in (select artist_id from good_artists)"
CTES |= {
    "good_artists": "select artist_id from artist_n intersect select artist_id from album_n intersect select artist_id from track_n",
    "le_c": "select * from le_t where artist_id in (select artist_id from good_artists) "
    "and album_id in (select album_id from album_c) and track_id in (select track_id from track_c)",
    "user_active": "select * from user_t where user_id in (select user_id from le_c)",
    "user_c": "select * replace (coalesce(country, 'NA') as country, coalesce(gender, 'NA') as gender) from user_active",
    "profile": "select user_id, case when country in ({}) then country else 'NA' end as country, "
    "case when age >= 0 then age end as age, case when age >= 0 then 'good' else 'NA' end as age_key, "
    "case when gender in ('m', 'f', 'n') then gender else 'n' end as gender, playcount from user_t".format(
        ", ".join(f"'{c}'" for c in MARGINS["country"])
    ),
    "eligible_u": "select * from profile where (age is null or (age > 15.7 and age < 35.1)) and playcount > 7083 and playcount < 24841",
    "genres_d": "select cast(genre_id as bigint) as genre_id, genre_name from genres_raw union all select count(*), 'na' from genres_raw",
    "genre_named": "select artist_id, cast(genre_id as bigint) as genre_id from artist_genre_raw join "
    "(select artist_name, max(artist_id) as artist_id from artist_c group by artist_name) o using (artist_name)",
    "genre_pairs": "select artist_id, genre_id from genre_named union all "
    "select artist_id, (select max(genre_id) from genres_d) from (select distinct artist_id from artist_c) a "
    "where artist_id not in (select artist_id from genre_named)",
    "genre_ids": "select genre_id as raw_id, genre_id as node_id from genres_d",
    "artist_plays": "select a.artist_id, count(e.artist_id) as plays from (select distinct artist_id from artist_t) a "
    "left join le_t e on a.artist_id = e.artist_id group by a.artist_id",
    "cutoff_1": "select round_even(avg(plays) + 1.0 * stddev_pop(plays), 0) as cutoff from artist_plays",
    "good_popular": "select artist_id from good_artists intersect select artist_id from popular",
    "popular": "select artist_id, plays from artist_plays where plays > (select cutoff from cutoff_1)",
}
for kind in ("user", "artist", "album", "track"):
    CTES[f"{kind}_ids"] = f"select raw_id, row_number() over (order by raw_id) - 1 as node_id from (select distinct {kind}_id as raw_id from {kind}_c) d"
for kind in ("artist", "album", "track"):
    CTES[f"dense_{kind}"] = (
        f'select u.node_id as "user", i.node_id as item, "timestamp" as ts from le_c '
        f"join user_ids u on user_id = u.raw_id join {kind}_ids i on {kind}_id = i.raw_id"
    )
    CTES[f"listened_to_{kind}"] = (
        f'select "user" as src, item as dst, row_number() over (order by ts, "user", item) - 1 as edge_id, ts from dense_{kind}'
    )
    CTES[f"{kind}_listened_by"] = f"select dst as src, src as dst, edge_id, ts from listened_to_{kind}"
    CTES[f"plays_{kind}"] = f'select "user", item, count(*) as plays from dense_{kind} group by "user", item'
CTES |= {
    "in_genre": "select node_id as src, genre_id as dst, row_number() over (order by node_id, genre_id) - 1 as edge_id "
    "from genre_pairs join artist_ids on artist_id = raw_id",
    "is_genre_of": "select dst as src, src as dst, edge_id from in_genre",
    "produced": "select a.node_id as src, b.node_id as dst, row_number() over (order by a.node_id, b.node_id) - 1 as edge_id "
    "from album_c join artist_ids a on artist_id = a.raw_id join album_ids b on album_id = b.raw_id",
    "produced_by": "select dst as src, src as dst, edge_id from produced",
    "preformed_by": "select t.node_id as src, a.node_id as dst, row_number() over (order by t.node_id, a.node_id) - 1 as edge_id "
    "from track_c join track_ids t on track_id = t.raw_id join artist_ids a on artist_id = a.raw_id",
    "preformed": "select dst as src, src as dst, edge_id from preformed_by",
}

WALK_PATH = (
    "listened_to_track",
    "track_listened_by",
    "listened_to_album",
    "album_listened_by",
    "listened_to_artist",
    "in_genre",
    "is_genre_of",
    "artist_listened_by",
)
WALK_ENDS = ("user", "track", "user", "album", "user", "artist", "genre", "artist", "user")
WALK_LENGTH, WALKS, WINDOW, NEGATIVES = 8, 3, 7, 10
for relation in WALK_PATH:
    CTES[f"near_{relation}"] = (
        "select src, dst, row_number() over (partition by src order by dst, edge_id) - 1 as rank, "
        f"count(*) over (partition by src) as degree from {relation}"
    )
CTES["walk_0"] = f"select node_id * {WALKS} + copy as walk_id, node_id from user_ids, range({WALKS}) r(copy)"
for step, relation in enumerate(WALK_PATH, 1):
    CTES[f"walk_{step}"] = (
        f"select w.walk_id, n.dst as node_id from walk_{step - 1} w join near_{relation} n on w.node_id = n.src "
        f"and n.rank = {draw('w.walk_id', str(step), seed=7)} % n.degree"
    )
CTES["walk_steps"] = " union all ".join(
    f"select walk_id, {step} as step, '{kind}' as node_type, node_id from walk_{step}" for step, kind in enumerate(WALK_ENDS)
)
CTES["node_sizes"] = " union all ".join(
    f"select '{k}' as node_type, count(*) as n from {k}_ids" for k in ("user", "artist", "album", "track", "genre")
)

for kind in ("artist", "album", "track"):
    CTES[f"shares_listened_to_{kind}"] = (
        'select "user" as src, item as dst, row_number() over (order by "user", item) - 1 as edge_id, '
        f'plays / sum(plays) over (partition by "user") as weight from plays_{kind}'
    )
    CTES[f"shares_{kind}_listened_by"] = f"select dst as src, src as dst, edge_id, weight from shares_listened_to_{kind}"

DIM, RATE = 4, 0.5
CTES["sgns_pairs"] = (
    "select 'user' as a_type, \"user\" as a_id, 'artist' as b_type, item as b_id, 1 as label from plays_artist union all "
    "select 'user', \"user\", 'artist', " + draw('"user"', "item", seed=13) + " % (select count(*) from artist_ids), 0 from plays_artist"
)
CTES["sgns_nodes"] = "select 'user' as node_type, node_id from user_ids union all select 'artist', node_id from artist_ids"
CTES["sgns_vec"] = (
    f"select node_type, node_id, k, ({draw('node_type', 'node_id', 'k', seed=3)} % 2001 - 1000) / 1000.0::double / {DIM} as x "
    f"from sgns_nodes, range({DIM}) r(k)"
)
CTES["sgns_p"] = (
    "select p.*, row_number() over () as pair from sgns_pairs p"
)
CTES["sgns_dot"] = (
    "select p.pair, any_value(label) as label, sum(a.x * b.x) as dot from sgns_p p join sgns_vec a on a.node_type = a_type and a.node_id = a_id "
    "join sgns_vec b on b.node_type = b_type and b.node_id = b_id and a.k = b.k group by p.pair"
)
CTES["sgns_g"] = "select p.*, 1 / (1 + exp(-dot)) - p.label as g from sgns_p p join sgns_dot d using (pair)"
CTES["sgns_part"] = (
    "select a_type as node_type, a_id as node_id, b.k, g * b.x as dx from sgns_g join sgns_vec b on b.node_type = b_type and b.node_id = b_id union all "
    "select b_type, b_id, a.k, g * a.x from sgns_g join sgns_vec a on a.node_type = a_type and a.node_id = a_id"
)
CTES["sgns_sum"] = "select node_type, node_id, k, avg(dx) as dx from sgns_part group by node_type, node_id, k"

# quotas: floors, then single units in rounds over the values (see sampling.apportion)
CTES["quota_n"] = "select count(*) // 4 as n from eligible_u"
CTES["shares"] = "select * from (values {}) s(margin, value, share)".format(
    ", ".join(f"('{m}', '{v}', {s})" for m, values in MARGINS.items() for v, s in values.items())
)
CTES["floors"] = (
    "select margin, value, share * n // 100000 as q, share * n % 100000 as rest, "
    "n - sum(share * n // 100000) over (partition by margin) as missing, count(*) over (partition by margin) as k, "
    "row_number() over (partition by margin order by share * n % 100000 desc, value) as up from shares, quota_n"
)
CTES["levels"] = (
    "select f.margin, max(r) as level from floors f, (select unnest(range(0, (select max(q) + 1 from floors))) as r) x "
    "where (select sum(least(g.q, r)) from floors g where g.margin = f.margin) <= -f.missing group by f.margin"
)
CTES["lowered"] = (
    "select f.*, coalesce(level, 0) as level, q - least(q, coalesce(level, 0)) as q2, "
    "-missing - sum(least(q, coalesce(level, 0))) over (partition by f.margin) as over from floors f left join levels l on f.margin = l.margin"
)
CTES["quota"] = (
    "select margin, value, cast(case when missing >= 0 then q + missing // k + case when up <= missing % k then 1 else 0 end "
    "else q2 - case when q2 > 0 and row_number() over (partition by margin, q2 > 0 order by rest, value) <= over then 1 else 0 end end as bigint) as quota from lowered"
)


# the joint sample: users one by one, quotas as lists in order of their values
for _margin in MARGINS:
    CTES[f"{_margin}_quota"] = f"select list(quota order by value) as q, list(value order by value) as v from quota where margin = '{_margin}'"
CTES["quota_queue"] = (
    "select user_id, country, gender, age_key, row_number() over (order by md5('17:' || cast(user_id as varchar))) as turn, "
    + ", ".join(f"list_position((select v from {m}_quota), {m}) as at_{m}" for m in MARGINS)
    + " from eligible_u"
)
CTES["quota_turns"] = (
    "select 0::bigint as turn, false as taken, " + ", ".join(f"(select q from {m}_quota) as q_{m}" for m in MARGINS) + " union all "
    "select u.turn, " + " and ".join(f"q_{m}[at_{m}] > 0" for m in MARGINS) + ", "
    + ", ".join(
        f"list_transform(q_{m}, lambda x, i: x - case when i = at_{m} and {' and '.join(f'q_{o}[at_{o}] > 0' for o in MARGINS)} then 1 else 0 end)"
        for m in MARGINS
    )
    + " from quota_turns t join quota_queue u on u.turn = t.turn + 1"
)
CTES["quota_sample"] = "select user_id, country, gender, age_key from quota_queue join (select turn, taken from quota_turns) using (turn) where taken"


def closed(select: str) -> str:
    """The statement behind all the common table expressions it needs, in order of need."""
    order: list[str] = []

    def need(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"[a-z_0-9]+", text)):
            if word in CTES and word not in order and word not in pending:
                pending.append(word)
                need(CTES[word])
                pending.remove(word)
                order.append(word)

    pending: list[str] = []
    need(select)
    if not order:
        return select
    how = lambda name: "" if name == "quota_turns" else "materialized "  # noqa: E731 - a recursive table cannot be
    return "with recursive " + ",\n".join(f"{name} as {how(name)}(\n{CTES[name]}\n)" for name in order) + "\n" + select

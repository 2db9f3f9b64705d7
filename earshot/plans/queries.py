"""The registered queries of the listening engine, each with its DuckDB counterpart."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schemas import COLUMNS, invalid, timestamp_seconds, typed, valid
from ..operators import clean as C
from ..operators import embed, encode, playcount, sampling, walks
from ..operators.edges import RELATIONS, REVERSE, Graph, genres_by_name, genres_or_default, identity_features, relations_of
from ..operators.ids import dense_ids, remap
from ..sources import adapter
from ..sources.event_store import write_events
from ..sources.raw import genre_dictionary, genre_lines, row_count, scan_clean, split_raw
from ..sources.staging import staged, staging_dir
from ..sources.store import graph_counts, read_vectors, write_graph, write_table, write_vectors
from . import oracles as O
from .pipelines import KINDS, build_graph, clean_all, count_edges, count_nodes, embed_graph, marked_ids, numbered, stage_tables, subset_users, union_all

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SEED = 17
ITEMS = ("artist", "album", "track")


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = O.closed(sql)
        return query

    return add


def _typed(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return typed(adapter.raw(spark, d, O.RAW[kind]))


def _table(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return valid(_typed(spark, d, kind))


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {kind: _table(spark, d, kind) for kind in O.RAW}


def _clean(spark: SparkSession, d: str, *kinds: str) -> dict[str, DataFrame]:
    return clean_all(_tables(spark, d), kinds=kinds or KINDS)


def _named(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return C.named(_table(spark, d, kind), f"{kind}_id", f"{kind}_name")


def _genres(spark: SparkSession, d: str) -> DataFrame:
    return genre_dictionary(adapter.raw(spark, d, "genres_raw"))


def _staged(spark: SparkSession, d: str, *kinds: str) -> dict[str, DataFrame]:
    return stage_tables(_clean(spark, d, *kinds), kinds)


def _graph(spark: SparkSession, d: str, kinds: tuple[str, ...] = ITEMS, **options) -> Graph:
    cleaned = _staged(spark, d, "le", "user", *kinds)
    on = {f"{k}s": k in kinds for k in ITEMS}
    return build_graph(cleaned, adapter.raw(spark, d, "artist_genre_raw"), _genres(spark, d), **on, **options)


def _profile(spark: SparkSession, d: str) -> DataFrame:
    return C.user_profile(_table(spark, d, "user"), list(sampling.COUNTRIES), list(sampling.GENDERS))


def _eligible(spark: SparkSession, d: str) -> DataFrame:
    return C.eligible(_profile(spark, d))


def _dense(spark: SparkSession, d: str, item: str) -> DataFrame:
    cleaned = _staged(spark, d, "le", "user", item)
    marked = marked_ids(cleaned, ("user", item))
    return playcount.number_events(cleaned["le"], marked["user"], marked[item], item)


# Scans


@register("scan_entity", "select artist_id, artist_name from artist_t")
def scan_entity(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "artist")


@register("scan_events", "select * from le_t")
def scan_events(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "le")


@register("genre_lines", "select artist_name, cast(genre_id as bigint) as genre_id from artist_genre_raw")
def genre_lines_query(spark: SparkSession, d: str) -> DataFrame:
    """Ragged lines joined by tabs, and read again."""
    pairs = adapter.raw(spark, d, "artist_genre_raw")
    ids = F.array_join(F.collect_list(F.col("genre_id").cast("string")), "\t")
    lines = pairs.groupBy("artist_name").agg(ids.alias("ids"))
    return genre_lines(lines.select(F.concat_ws("\t", "artist_name", "ids").alias("value")))


@register("genre_dictionary", "select genre_id, genre_name from genres_d")
def genre_dictionary_query(spark: SparkSession, d: str) -> DataFrame:
    return _genres(spark, d)


@register("row_count", "select count(*) as n_rows from les_raw")
def row_count_query(spark: SparkSession, d: str) -> DataFrame:
    return row_count(adapter.raw(spark, d, "les_raw"))


# Columns and predicates


@register("typed_columns", "select * from user_all")
def typed_columns(spark: SparkSession, d: str) -> DataFrame:
    return _typed(spark, d, "user")


@register("valid_rows", "select * from user_t")
def valid_rows(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "user")


@register("invalid_rows", f"select * from users_raw where {' or '.join(f'{O.integer(c)} is null' for c in O.INTEGERS['user'])}")
def invalid_rows(spark: SparkSession, d: str) -> DataFrame:
    return invalid(adapter.raw(spark, d, "users_raw"))


@register("project_ids", "select album_id, artist_id from album_t")
def project_ids(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "album").select("album_id", "artist_id")


@register("order_seconds", "select o_orderkey, cast(epoch(o_orderdate) as bigint) as seconds from orders")
def order_seconds(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return orders.select("o_orderkey", timestamp_seconds(F.col("o_orderdate")).alias("seconds"))


@register("fill_user_attrs", "select * replace (coalesce(country, 'NA') as country, coalesce(gender, 'NA') as gender) from user_t")
def fill_user_attrs(spark: SparkSession, d: str) -> DataFrame:
    return C.fill_attributes(_table(spark, d, "user"))


@register("user_profile", "select * from profile")
def user_profile(spark: SparkSession, d: str) -> DataFrame:
    return _profile(spark, d)


@register("eligible_users", "select * from eligible_u")
def eligible_users(spark: SparkSession, d: str) -> DataFrame:
    return _eligible(spark, d)


@register("unnamed_ids", " union all ".join(f"select '{k}' as kind, {k}_id as id from {k}_unnamed" for k in ITEMS))
def unnamed_ids(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for k in ITEMS:
        ids = C.unnamed_ids(_table(spark, d, k), f"{k}_id", f"{k}_name")
        parts.append(ids.select(F.lit(k).alias("kind"), F.col(f"{k}_id").alias("id")))
    return union_all(parts)


# Joins


@register("semi_filter", "select * from album_t where artist_id in (select artist_id from good_artists)")
def semi_filter(spark: SparkSession, d: str) -> DataFrame:
    good = C.good_artist_ids(*(_named(spark, d, k) for k in ITEMS))
    return C.keep_ids(_table(spark, d, "album"), good, "artist_id")


@register("anti_filter", "select * from track_n")
def anti_filter(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d, "track")


@register("filter_events", "select * from le_c")
def filter_events(spark: SparkSession, d: str) -> DataFrame:
    names = {k: _named(spark, d, k) for k in ITEMS}
    good = C.good_artist_ids(names["artist"], names["album"], names["track"])
    keys = {"artist_id": good}
    for k in ("album", "track"):
        keys[f"{k}_id"] = C.keep_ids(names[k], good, "artist_id").select(f"{k}_id")
    return C.filter_events(_table(spark, d, "le"), keys)


@register("active_users", "select * from user_active")
def active_users(spark: SparkSession, d: str) -> DataFrame:
    return C.active_users(_table(spark, d, "user"), _clean(spark, d, "le")["le"])


@register("remap_ids", "select node_id as artist_id, album_id, album_name from album_c join artist_ids on artist_id = raw_id")
def remap_ids(spark: SparkSession, d: str) -> DataFrame:
    cleaned = _staged(spark, d, "album", "artist")
    return remap(cleaned["album"], numbered(cleaned, "artist"), "artist_id")


@register("events_dense", 'select "user", item, ts from dense_track')
def events_dense(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d, "track")


@register("artist_genre_named", "select artist_id, genre_id from genre_named")
def artist_genre_named(spark: SparkSession, d: str) -> DataFrame:
    return genres_by_name(adapter.raw(spark, d, "artist_genre_raw"), _clean(spark, d, "artist")["artist"])


@register("artist_genre_default", "select artist_id, genre_id from genre_pairs")
def artist_genre_default(spark: SparkSession, d: str) -> DataFrame:
    artists = _clean(spark, d, "artist")["artist"]
    pairs = genres_by_name(adapter.raw(spark, d, "artist_genre_raw"), artists)
    return genres_or_default(pairs, artists, _genres(spark, d))


@register(
    "dangling_ids",
    "select distinct artist_id from (select artist_id from album_t union all select artist_id from track_t "
    "union all select artist_id from le_t) x where artist_id not in (select artist_id from artist_n)",
)
def dangling_ids(spark: SparkSession, d: str) -> DataFrame:
    lists = [_table(spark, d, k).select("artist_id") for k in ("album", "track", "le")]
    return C.dangling_ids(_named(spark, d, "artist").select("artist_id"), lists)


@register("artist_popularity", "select artist_id, plays from artist_plays")
def artist_popularity(spark: SparkSession, d: str) -> DataFrame:
    return playcount.popularity(_table(spark, d, "artist"), _table(spark, d, "le"))


# Aggregates


@register(
    "distinct_ids",
    " union all ".join(f"select distinct '{c}' as id_column, {c} as id from le_t" for c in ("user_id", "artist_id", "album_id", "track_id")),
)
def distinct_ids(spark: SparkSession, d: str) -> DataFrame:
    return C.distinct_ids(_table(spark, d, "le"), ["user_id", "artist_id", "album_id", "track_id"])


@register("user_total_plays", 'select "user", count(*) as plays from dense_artist group by "user"')
def user_total_plays(spark: SparkSession, d: str) -> DataFrame:
    return playcount.user_plays(_dense(spark, d, "artist"))


@register("popularity_cutoff", "select round_even(avg(plays) + 2.5 * stddev_pop(plays), 0) as cutoff from artist_plays")
def popularity_cutoff(spark: SparkSession, d: str) -> DataFrame:
    return playcount.popularity_cutoff(artist_popularity(spark, d))


@register("popular_artists", "select artist_id, plays from popular")
def popular_artists(spark: SparkSession, d: str) -> DataFrame:
    return playcount.popular_artists(artist_popularity(spark, d), sigmas=1.0)


@register("node_counts", "select node_type, n from node_sizes")
def node_counts(spark: SparkSession, d: str) -> DataFrame:
    return count_nodes(_clean(spark, d, "user", *ITEMS), _genres(spark, d))


@register("edge_counts", " union all ".join(f"select '{r}' as relation, count(*) as n from {r}" for r in RELATIONS))
def edge_counts(spark: SparkSession, d: str) -> DataFrame:
    return _combination(ITEMS, spark, d)


@register(
    "closure_check",
    "select *, n_rows = n_albums and n_rows = n_tracks as closed from (select (select count(*) from artist_c) as n_rows, "
    "(select count(distinct artist_id) from album_c) as n_albums, (select count(distinct artist_id) from track_c) as n_tracks) x",
)
def closure_check(spark: SparkSession, d: str) -> DataFrame:
    cleaned = _clean(spark, d, *ITEMS)
    return C.closure_check(*(cleaned[k] for k in ITEMS))


# Order and sets


@register("events_chronological", 'select src as "user", dst as item, edge_id, ts from listened_to_track')
def events_chronological(spark: SparkSession, d: str) -> DataFrame:
    return playcount.chronological(staged(_dense(spark, d, "track"), "dense"), buckets=8)


@register("good_artist_ids", "select artist_id from good_artists")
def good_artist_ids(spark: SparkSession, d: str) -> DataFrame:
    return C.good_artist_ids(*(_named(spark, d, k) for k in ITEMS))


# Samples


@register(
    "quota_apportion",
    "select q.margin, q.value, quota, count(p.value) as available from quota q left join ("
    + " union all ".join(f"select '{m}' as margin, {m} as value from eligible_u" for m in sampling.MARGINS)
    + ") p on p.margin = q.margin and p.value = q.value group by q.margin, q.value, quota",
)
def quota_apportion(spark: SparkSession, d: str) -> DataFrame:
    people = _eligible(spark, d)
    return sampling.quota_table(people, people.count() // 4)


@register("seeded_order", f"select *, md5('{SEED}:' || cast(user_id as varchar)) as order_key from eligible_u")
def seeded_order(spark: SparkSession, d: str) -> DataFrame:
    return sampling.seeded_order(_eligible(spark, d), "user_id", SEED)


@register(
    "stratified_sample",
    "select user_id, country, place from (select user_id, country, row_number() over (partition by country "
    f"order by md5('{SEED}:' || cast(user_id as varchar))) as place from eligible_u) r "
    "join quota on margin = 'country' and value = country where place <= quota",
)
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    people = _eligible(spark, d)
    quota = sampling.quotas(people.count() // 4)["country"]
    return sampling.stratified_sample(people, "country", quota, SEED)


@register("quota_sample_users", "select user_id, country, gender, age_key from quota_sample")
def quota_sample_users(spark: SparkSession, d: str) -> DataFrame:
    people = _eligible(spark, d)
    return sampling.quota_sample(people, people.count() // 4, SEED)


# Graph


def _edges(relation: str, spark: SparkSession, d: str) -> DataFrame:
    kinds = tuple(k for k in ITEMS if k in RELATIONS[relation])
    return _graph(spark, d, kinds, relations=[relation]).edges[relation]


for _relation in ("in_genre", "produced", "preformed_by"):
    for _r in (_relation, REVERSE[_relation]):
        register(f"edges_{_r}", f"select src, dst, edge_id from {_r}")(partial(_edges, _r))


def _playcount(item: str, spark: SparkSession, d: str) -> DataFrame:
    return playcount.playcount(_dense(spark, d, item))


def _relative(item: str, spark: SparkSession, d: str) -> DataFrame:
    return playcount.relative_playcount(_dense(spark, d, item))


def _weighted(item: str, spark: SparkSession, d: str) -> DataFrame:
    relation = f"listened_to_{item}"
    return _graph(spark, d, (item,), weighted=True, relations=[relation]).edges[relation]


for _item in ITEMS:
    register(f"playcount_{_item}", f'select "user", item, plays from plays_{_item}')(partial(_playcount, _item))
    register(
        f"relative_playcount_{_item}",
        f'select "user", item, plays / sum(plays) over (partition by "user") as share from plays_{_item}',
    )(partial(_relative, _item))
    register(f"listen_edges_{_item}", f"select src, dst, edge_id, ts from listened_to_{_item}")(partial(_edges, f"listened_to_{_item}"))
    register(
        f"weighted_edges_{_item}",
        'select "user" as src, item as dst, row_number() over (order by "user", item) - 1 as edge_id, '
        f"cast(plays as double) as weight from plays_{_item}",
    )(partial(_weighted, _item))


def _ids(kind: str, spark: SparkSession, d: str) -> DataFrame:
    return dense_ids(_staged(spark, d, kind)[kind], f"{kind}_id", buckets=8)


def _cleaned(kind: str, spark: SparkSession, d: str) -> DataFrame:
    return _clean(spark, d, kind)[kind]


for _kind in O.RAW:
    _plural = {"le": "events"}.get(_kind, f"{_kind}s")
    register(f"clean_{_plural}", f"select * from {_kind}_c")(partial(_cleaned, _kind))
    if _kind != "le":
        register(f"dense_ids_{_kind}", f"select raw_id, node_id from {_kind}_ids")(partial(_ids, _kind))


def _combination(kinds: tuple[str, ...], spark: SparkSession, d: str) -> DataFrame:
    cleaned = _staged(spark, d, "le", "user", *kinds)
    return count_edges(cleaned, adapter.raw(spark, d, "artist_genre_raw"), _genres(spark, d), *(k in kinds for k in ITEMS))


for _kinds in (("artist",), ("album",), ("track",), ("artist", "album"), ("artist", "track"), ("album", "track"), ITEMS):
    _found = relations_of(*(k in _kinds for k in ITEMS))
    register(
        "edge_counts_" + "_".join(_kinds), " union all ".join(f"select '{r}' as relation, count(*) as n from {r}" for r in _found)
    )(partial(_combination, _kinds))


@register(
    "graph_validate",
    " union all ".join(
        f"select '{r}' as relation, count(*) filter (where src < 0 or src >= (select count(*) from {a}_ids)) as bad_src, "
        f"count(*) filter (where dst < 0 or dst >= (select count(*) from {b}_ids)) as bad_dst from {r}"
        for r, (a, b) in RELATIONS.items()
    ),
)
def graph_validate(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d).validate()


@register(
    "node_features_identity",
    " union all ".join(f"select '{k}' as node_type, node_id, [cast(node_id as float)] as feat from {k}_ids" for k in ("user", *ITEMS, "genre")),
)
def node_features_identity(spark: SparkSession, d: str) -> DataFrame:
    return identity_features(_graph(spark, d).node_table())


@register(
    "build_graph",
    " union all ".join(
        f"select '{r}' as relation, src, dst, edge_id, "
        + ("weight" if "listened" in r else "null::double as weight")
        + " from "
        + (f"shares_{r}" if "listened" in r else r)
        for r in RELATIONS
    ),
)
def build_graph_query(spark: SparkSession, d: str) -> DataFrame:
    """Every edge of the full weighted graph."""
    graph = _graph(spark, d, weighted=True, normalize=True)
    parts = []
    for relation, edges in graph.edges.items():
        weight = F.col("weight") if "weight" in edges.columns else F.lit(None).cast("double")
        parts.append(edges.select(F.lit(relation).alias("relation"), "src", "dst", "edge_id", weight.alias("weight")))
    return union_all(parts)


# Walks and embeddings


def _starts(spark: SparkSession, d: str) -> tuple[Graph, DataFrame]:
    graph = _graph(spark, d)
    return graph, graph.nodes["user"].select("node_id")


@register("metapath_walks", "select walk_id, step, node_type, node_id from walk_steps")
def metapath_walks(spark: SparkSession, d: str) -> DataFrame:
    graph, starts = _starts(spark, d)
    return walks.walks(starts, graph.ends(), walks.metapath(ITEMS), O.WALK_LENGTH, O.WALKS)


@register(
    "walk_contexts",
    "select walk_id, step, apart, types[step + 1] as a_type, nodes[step + 1] as a_id, types[step + apart + 1] as b_type, "
    "nodes[step + apart + 1] as b_id from (select walk_id, list(node_id order by step) as nodes, list(node_type order by step) as types "
    f"from walk_steps group by walk_id) w, range({O.WALK_LENGTH + 2 - O.WINDOW}) s(step), range(1, {O.WINDOW}) p(apart) "
    "where step + apart < len(nodes)",
)
def walk_contexts(spark: SparkSession, d: str) -> DataFrame:
    return walks.contexts(walks.walk_arrays(metapath_walks(spark, d)), O.WINDOW, O.WALK_LENGTH)


@register(
    "negative_walks",
    "select walk_id, negative, step, node_type, case when step = 0 then start else "
    + O.draw("walk_id", "negative", "step", seed=11)
    + f" % n end as node_id from (select node_id * {O.WALKS} + copy as walk_id, node_id as start, negative, step, "
    f"case step % {len(O.WALK_PATH)} {' '.join(f"when {k} then '{t}'" for k, t in enumerate(O.WALK_ENDS[:-1]))} end as node_type "
    f"from user_ids, range({O.WALKS}) c(copy), range({O.NEGATIVES}) g(negative), range({O.WALK_LENGTH + 1}) s(step)) w join node_sizes using (node_type)",
)
def negative_walks(spark: SparkSession, d: str) -> DataFrame:
    counts = {r.node_type: r.n for r in node_counts(spark, d).collect()}
    starts = spark.range(counts.get("user", 0)).toDF("node_id")  # dense ids are the numbers below their count
    return walks.negative_walks(starts, counts, walks.metapath(ITEMS), O.WALK_LENGTH, O.WALKS, O.NEGATIVES)


def _pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    graph, _ = _starts(spark, d)
    played = graph.ends()["listened_to_artist"].groupBy(F.col("src").alias("user"), F.col("dst").alias("item")).count()
    played = staged(played, "played")  # read for the real and the drawn pairs, each twice
    size = graph.nodes["artist"].count()
    ends = [F.lit("user").alias("a_type"), F.col("user").alias("a_id"), F.lit("artist").alias("b_type")]
    real = played.select(*ends, F.col("item").alias("b_id"), F.lit(1).alias("label"))
    drawn = F.pmod(walks.draw(F.col("user"), F.col("item"), seed=13), F.lit(size)).alias("b_id")
    pairs = real.unionByName(played.select(*ends, drawn, F.lit(0).alias("label")))
    return pairs, graph.node_table().where(F.col("node_type").isin("user", "artist")).select("node_type", "node_id")


@register(
    "sgns_step",
    f"select v.node_type, v.node_id, cast(v.k as int) as k, round(x - {O.RATE} * coalesce(dx, 0), 6) as value from sgns_vec v "
    "left join sgns_sum s on v.node_type = s.node_type and v.node_id = s.node_id and v.k = s.k",
)
def sgns_step(spark: SparkSession, d: str) -> DataFrame:
    pairs, nodes = _pairs(spark, d)
    moved = embed.sgns_step(pairs, embed.start_vectors(nodes, O.DIM), O.DIM, O.RATE)
    parts = moved.select("node_type", "node_id", F.posexplode("vec").alias("k", "x"))
    return parts.select("node_type", "node_id", "k", F.round("x", 6).alias("value"))


@register("node_embeddings")
def node_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all nodes of the full graph, from walks once round its metapath; all else by default."""
    return embed_graph(_graph(spark, d), length=O.WALK_LENGTH)


# Encoders


@register("encode_identity", "select user_id, [cast(playcount as float)] as vec from user_t")
def encode_identity(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "user").select("user_id", encode.encode_identity("playcount").alias("vec"))


@register(
    "encode_categorical",
    "select c_custkey, (select list(cast(case when v = c_mktsegment then 1 else 0 end as float) order by v) "
    "from (select distinct c_mktsegment as v from customer where c_mktsegment is not null) s) as vec from customer",
)
def encode_categorical(spark: SparkSession, d: str) -> DataFrame:
    customers = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_mktsegment")
    return encode.encode_categorical(customers, "c_mktsegment", "vec").select("c_custkey", "vec")


@register(
    "encode_text",
    "with w as (select doc_id, unnest(string_split(lower(text), ' ')) as word from documents), "
    "c as (select doc_id, cast('0x' || substr(md5(word), 1, 8) as bigint) % 16 as b, count(*) as n from w where word <> '' group by all), "
    "g as (select x.doc_id, k, coalesce(n, 0)::double as n from (select distinct doc_id from documents) x cross join range(16) r(k) "
    "left join c on c.doc_id = x.doc_id and c.b = k), "
    "s as (select doc_id, sqrt(sum(n * n)) as norm from g group by doc_id) "
    "select doc_id, list(case when norm > 0 then round(n / norm, 6) else 0 end order by k) as vec from g join s using (doc_id) group by doc_id",
)
def encode_text(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_text(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text", 16)


# Stored tables, written and read back


def _place(spark: SparkSession, name: str) -> str:
    return f"{staging_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register("stored_events", "select * from le_c")
def stored_events(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned events through a store by user."""
    return write_events(_clean(spark, d, "le")["le"], _place(spark, "store")).events()


@register("stored_playcounts", " union all ".join(f"select '{k}' as item_type, \"user\", item, plays from plays_{k}" for k in ITEMS))
def stored_playcounts(spark: SparkSession, d: str) -> DataFrame:
    """Plays of all item types, by one shuffle of events."""
    cleaned = _staged(spark, d, "le", "user", *ITEMS)
    marked = marked_ids(cleaned, ("user", *ITEMS))
    rows = playcount.number_all(cleaned["le"], marked["user"], {k: marked[k] for k in ITEMS})
    store = write_events(rows, _place(spark, "store"), "user", "ts")
    plays = lambda events, k: playcount.playcount(playcount.of_item(events, k)).select(F.lit(k).alias("item_type"), "user", "item", "plays")
    return union_all([store.by_user(partial(plays, k=k)) for k in ITEMS])


@register("stored_table", "select * from album_c")
def stored_table(spark: SparkSession, d: str) -> DataFrame:
    """A cleaned table through tab-separated text and the strict scan."""
    path = _place(spark, "albums")
    write_table(_clean(spark, d, "album")["album"], path, "tsv")
    return scan_clean(spark, path, "album")


@register(
    "raw_rejects",
    "select 'type of user_id' as reason, "
    + " || chr(9) || ".join(f"coalesce({c}, '')" for c in COLUMNS["user"])
    + f" as row from users_raw where {O.integer('user_id')} is null",
)
def raw_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a raw file that cannot be read, with the reason."""
    path = _place(spark, "users")
    adapter.raw(spark, d, "users_raw").write.csv(path, sep="\t", header=True)
    _, rejects, _ = split_raw(spark, path, "user")
    return rejects.select("reason", "row")


@register("stored_vectors", f"select node_type, node_id, list(round(x, 6) order by k) as vec from sgns_vec where node_type = 'artist' group by node_type, node_id")
def stored_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of one node type out of those of all."""
    path = _place(spark, "vectors")
    nodes = _graph(spark, d, ("artist",)).node_table().where(F.col("node_type").isin("user", "artist"))
    write_vectors(embed.start_vectors(nodes.select("node_type", "node_id"), O.DIM), path)
    found = read_vectors(spark, path, "artist")
    return found.select("node_type", "node_id", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


@register(
    "stored_graph_counts",
    "select 'node' as part, node_type as name, n from node_sizes union all "
    + " union all ".join(f"select 'edge' as part, '{r}' as name, count(*) as n from {r}" for r in REVERSE),
)
def stored_graph_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a graph written whole and loaded again."""
    path = _place(spark, "graph")
    write_graph(_graph(spark, d), path)
    return graph_counts(spark, path)


@register(
    "metapath_table",
    " union all ".join(
        f"select {k} as step, '{r}' as relation, '{a}' as src_type, '{b}' as dst_type, count(*) as n from {r}"
        for k, (r, a, b) in enumerate(zip(O.WALK_PATH, O.WALK_ENDS[:-1], O.WALK_ENDS[1:], strict=True))
    ),
)
def metapath_table(spark: SparkSession, d: str) -> DataFrame:
    """The metapath of the full graph with the edges of each of its relations."""
    path = walks.metapath(ITEMS)
    rows = [(k, r, *RELATIONS[r]) for k, r in enumerate(path)]
    table = spark.createDataFrame(rows, "step int, relation string, src_type string, dst_type string")
    return F.broadcast(table).join(_combination(ITEMS, spark, d), "relation").select("step", "relation", "src_type", "dst_type", "n")


# Subsets


@register("subset_events", "select * from le_c where user_id in (select user_id from quota_sample)")
def subset_events(spark: SparkSession, d: str) -> DataFrame:
    users = _table(spark, d, "user")
    picked = subset_users(users, C.eligible(_profile(spark, d)).count() // 4, SEED)
    return clean_all(_tables(spark, d), users=picked, kinds=("le",))["le"]


@register(
    "clean_events_popular",
    "select * from le_t where artist_id in (select artist_id from good_popular) "
    "and album_id in (select album_id from album_n where artist_id in (select artist_id from good_popular)) "
    "and track_id in (select track_id from track_n where artist_id in (select artist_id from good_popular))",
)
def clean_events_popular(spark: SparkSession, d: str) -> DataFrame:
    return clean_all(_tables(spark, d), popular_sigmas=1.0, kinds=("le",))["le"]

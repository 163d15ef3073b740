"""The corpus queries, each over its whole table, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_sql
from .collocations import collocations_sql
from .common import Scratch, table
from .prefix_trie import trie_sql


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import licence_matches

    found = licence_matches(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "sentences", F.array_join("identifiers", ",").alias("identifiers"),
        F.array_join(F.transform("matches", lambda m: F.concat(m["at"].cast("string"), F.lit(":"), m["rule"])), ",").alias("rules"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import balanced_shards

    return balanced_shards(table(spark, sf_dir, "documents"), 40)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import taken_words

    mixed = taken_words(table(spark, sf_dir, "documents"))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"]).alias("taken")
    # A draw is pass:shard:words.
    drawn = F.transform("draws", lambda d: F.concat_ws(":", d["pass"].cast("string"), d["shard"].cast("string"), d["words"].cast("string")))
    return mixed.select("doc_id", "size", "source_size", "target", taken, "block", F.size("draws").alias("times"), F.array_join(drawn, ",").alias("draws"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op8_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bm25 import top_k

    return top_k(table(spark, sf_dir, "documents"), F.col("doc_id") % 50 == 0)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import classify, fold_of, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs)
    held = F.coalesce(fold_of("doc_id") == 0, F.lit(False)).alias("held_out")
    return classify(model, docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, "text"), keep_text=False)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_scan import document_token_counts

    folder = Scratch(spark, "token-scan").folder()
    # The vocabulary's own end-of-text id.
    return document_token_counts(table(spark, sf_dir, "documents"), folder, tokenizer_path(), 49_407, one_order=True)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import rebuilt_trie

    return rebuilt_trie(table(spark, sf_dir, "conversations"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    log = chat.log_of(chat.with_probe(spark, table(spark, sf_dir, "conversations")))
    return chat.digests(chat.read_back(chat.render(chat.fold(log))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": op1_ann,
    "op2_packing": op2_packing,
    "op3_licenses": op3_licenses,
    "op4_sharding": op4_sharding,
    "op5_url_filter": op5_url_filter,
    "op6_mixing": op6_mixing,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_bm25": op8_bm25,
    "op9_language_id": op9_language_id,
    "op10_token_counts": op10_token_counts,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_collocations": op12_collocations,
    "op13_chat_format": op13_chat_format,
}

def licenses_sql() -> str:
    from . import licenses as L

    text = lambda x: "'" + x.replace("'", "''") + "'"
    known = {L.normalised_text(k): v for k, v in L.SENTENCES.items()}
    names = "MAP {" + ", ".join(f"{text(k)}: {text(v)}" for k, v in known.items()) + "}"
    plain = "lower(coalesce(text, ''))"
    for kind, what, by in L.STEPS:
        plain = f"replace({plain}, {text(what)}, {text(by)})" if kind == "text" else f"regexp_replace({plain}, {text(what)}, {text(by)}, 'g')"
    holders = "CASE " + " ".join(f"WHEN starts_with(replace(x, chr(10) || chr(10), ' '), {text(begin)}) THEN {text(name)}" for begin, _, name in L.HOLDERS) + " END"
    hits = " UNION ALL ".join(
        f"SELECT r, doc_id, {order} AS o, {text(rule)} AS rule, {len(ids)} AS n, unnest(list_filter(range(len(ids)), lambda i: ids[i + 1:i + {len(ids)}] = [{', '.join(map(text, ids))}])) AS place FROM named"
        for order, (rule, _, ids) in enumerate(L.RULES)
    )
    return f"""
WITH cut AS (
  SELECT row_number() OVER () AS r, doc_id, chr(10) || trim({plain}, ' ') || chr(10) AS plain FROM documents
), named AS (
  SELECT r, doc_id, CAST(len(list_filter(string_split(plain, chr(10)), lambda x: x NOT IN ('', '.'))) AS BIGINT) AS sentences,
         list_transform(regexp_extract_all(plain, {text(L.sentence_pattern(L.SENTENCES))}, 1), lambda x: coalesce(({names})[replace(x, chr(10) || chr(10), ' ')], {holders})) AS ids
  FROM cut
), hits AS ({hits}), kept AS (
  SELECT r, string_agg(CAST(place AS VARCHAR) || ':' || rule, ',' ORDER BY place, o) AS rules FROM hits m
  WHERE NOT EXISTS (
    SELECT 1 FROM hits w WHERE w.r = m.r AND w.place < m.place + m.n AND m.place < w.place + w.n
      AND (w.n > m.n OR w.n = m.n AND w.o < m.o OR w.n = m.n AND w.o = m.o AND w.place < m.place))
  GROUP BY r
)
SELECT doc_id, sentences, coalesce(array_to_string(ids, ','), '') AS identifiers, coalesce(rules, '') AS rules
FROM named LEFT JOIN kept USING (r)"""


ORACLES: dict[str, str] = {"op3_licenses": licenses_sql(), "op11_prefix_trie": trie_sql(), "op12_collocations": collocations_sql(), "op13_chat_format": format_sql()}

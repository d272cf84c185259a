"""The queries of the training-data operators, over whole tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, chat_format, decontaminate, html_extract, quality_classifier, quality_rules, sharding, simhash, substring_dedup, toxicity
from .common import read


def tokenizer_path() -> str:
    """The vocabulary file of op4; the path is a parameter of the operator."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_chat_formatting(spark, sf_dir):
    """Roles learnt from four fifths of the conversations, recovered for all."""
    c = read(spark, sf_dir, "conversations")
    fold = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(5))
    return chat_format.recover_roles(c.drop("role"), c.where(fold != 0))


def op2_toxicity(spark, sf_dir):
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y")))


def op3_sharding(spark, sf_dir):
    return sharding.assign_shards(read(spark, sf_dir, "documents"))


def op4_bpe(spark, sf_dir):
    return bpe.encode(read(spark, sf_dir, "documents"), tokenizer_path())


def op5_quality_rules(spark, sf_dir):
    return quality_rules.judge(read(spark, sf_dir, "documents"))


def op6_substring_dedup(spark, sf_dir):
    return substring_dedup.dedup_substrings(read(spark, sf_dir, "documents"), splits=(0.2,))


def op7_simhash(spark, sf_dir):
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op8_decontamination(spark, sf_dir):
    return decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("items")


def op9_html_extraction(spark, sf_dir):
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op10_quality_classifier(spark, sf_dir):
    return quality_classifier.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")))


QUERIES = {f.__name__: f for f in (op1_chat_formatting, op2_toxicity, op3_sharding, op4_bpe, op5_quality_rules, op6_substring_dedup, op7_simhash, op8_decontamination, op9_html_extraction, op10_quality_classifier)}

_SPACED = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_ALNUM = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The others need models, a tokenizer or a hash that SQL hasn't; tests/llm holds them against plain-Python versions,
#: the tokenizers library or held-out labels.
SQL: dict[str, str] = {
    "op3_sharding": """with tab as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda a, x: case when a & 1 = 1 then xor(3988292384, a >> 1) else a >> 1 end)) as t),
d as (select doc_id, strlen(coalesce(text, '')) + 8 as size, coalesce(text, '') as text, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::bigint as h from documents),
c as (select *, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::bigint)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) as crc from d, tab),
p as (select doc_id, size, crc, h, sum(size) over (order by h, doc_id rows unbounded preceding)::bigint - size as lo, row_number() over (order by h, doc_id) as pos, (select sum(size)::bigint from d) as total from c),
r as (select *, count(*) over w as n, min(lo) over w as run_lo, sum(size) over w as run_size from p window w as (partition by h)),
s as (select *, least((case when n > 1 and run_size * 24 * 50 <= total then 2 * run_lo + run_size else 2 * lo + size end) * 24 // (2 * total), 23)::int as shard from r)
select doc_id, size, crc::bigint as text_crc32, 'bytes' as law, shard, pos - min(pos) over (partition by shard) as slot, null::int as grown_shard from s""",
    "op6_substring_dedup": f"""with t as (select doc_id, {_SPACED} as w from documents),
win as (select doc_id, i, array_to_string(w[i : i + 49], ' ') as s from t, unnest(range(1, len(w) - 48)) u(i)),
dup as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by s) as first from win) where first < doc_id),
gone as (select distinct doc_id, i + j as p from dup, range(0, 50) r(j)),
words as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as p from t),
kept as (select doc_id, count(*) as n, string_agg(x, ' ' order by p) as txt from words anti join gone using (doc_id, p) group by doc_id)
select doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(txt, '')) as kept_sha256 from t left join kept using (doc_id)""",
    "op8_decontamination": f"""with d as (select doc_id, {_ALNUM} as w from documents), b as (select item_id::varchar as item_id, {_ALNUM} as w from benchmark),
bw as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as s from b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) u(i) where len(w) > 0),
dw as (select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') as s from d, (select distinct n from bw) l, unnest(range(1, len(w) - n + 2)) u(i)),
hit as (select doc_id, i, n, s from dw semi join bw using (s)),
cov as (select doc_id, count(distinct i + j) as n_hit from hit, range(0, 10) r(j) where j < n group by doc_id),
named as (select doc_id, list_sort(list(distinct item_id)) as items from hit join bw using (s) group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(len(items), 0) as n_items, sha256(coalesce(array_to_string(items, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join cov using (doc_id) left join named using (doc_id)""",
}

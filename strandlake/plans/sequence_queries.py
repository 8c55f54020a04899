"""Sequence operators on the driver's tables.

A document's or benchmark item's letters ACGT are its nucleotide sequence, its 20 amino acid letters its protein;
a user's events in order are a sequence of symbols.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions import codons
from strandlake.functions import sequences as s
from strandlake.operators import alignments, annotations, kmers, orfs, profiles
from strandlake.plans.registry import query, table
from strandlake.plans.shared import spread

AMINO = "ACDEFGHIKLMNPQRSTVWY"
NUC_SQL = "upper(regexp_replace(text, '[^ACGTacgt]', '', 'g'))"
PROT_SQL = f"upper(regexp_replace(text, '[^{AMINO}{AMINO.lower()}]', '', 'g'))"


def nucleotides(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    return spread(table(spark, sf_dir, name).select(key, "text")).select(F.col(key).alias("seq_id"), s.only(F.col("text"), "ACGT").alias("seq"))


def proteins(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    return spread(table(spark, sf_dir, name).select(key, "text")).select(F.col(key).alias("seq_id"), s.only(F.col("text"), AMINO).alias("seq"))


def _kmers_sql(name: str, key: str, k: int, out: str = "km") -> str:
    code = " + ".join(f"(instr('ACGT', seq[i + {j}]) - 1) * {4 ** (k - 1 - j)}" for j in range(k))
    return f"""{out}_s AS (SELECT {key} AS id, {NUC_SQL} AS seq FROM {name}),
{out}_p AS (SELECT id, seq, unnest(range(1, length(seq) - {k - 2})) AS i FROM {out}_s WHERE length(seq) >= {k}),
{out} AS (SELECT id, i - 1 AS pos, ({code})::BIGINT AS kmer FROM {out}_p)"""


# Scalar functions -----------------------------------------------------------------------


@query(f"SELECT doc_id AS seq_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM (SELECT doc_id, {NUC_SQL} AS seq FROM documents)")
def reverse_complement(spark, sf_dir):
    return nucleotides(spark, sf_dir).select("seq_id", s.reverse_complement(F.col("seq")).alias("rc"))


@query(
    f"SELECT doc_id AS seq_id, CASE WHEN seq = '' THEN '' ELSE array_to_string(list_transform(string_split(seq, ''), lambda c: (instr('ACGT', c) - 1)::VARCHAR), '') END AS codes FROM (SELECT doc_id, {NUC_SQL} AS seq FROM documents)"
)
def encode_symbols(spark, sf_dir):
    codes = F.transform(s.encode(F.col("seq"), s.NUCLEOTIDE), lambda c: c.cast("string"))
    return nucleotides(spark, sf_dir).select("seq_id", F.array_join(codes, "").alias("codes"))


@query(f"SELECT doc_id AS seq_id, {NUC_SQL} AS seq FROM documents")
def decode_codes(spark, sf_dir):
    return nucleotides(spark, sf_dir).select("seq_id", s.decode(s.encode(F.col("seq"), s.NUCLEOTIDE), s.NUCLEOTIDE).alias("seq"))


@query(
    f"""SELECT doc_id AS seq_id, symbol, (length(seq) - length(replace(seq, symbol, '')))::BIGINT AS n
FROM (SELECT doc_id, {NUC_SQL} AS seq FROM documents), (SELECT unnest(string_split('{s.NUCLEOTIDE_AMBIGUOUS}', '')) AS symbol)"""
)
def symbol_frequency(spark, sf_dir):
    made = nucleotides(spark, sf_dir).select("seq_id", F.explode(s.frequencies(F.col("seq"), s.NUCLEOTIDE_AMBIGUOUS)).alias("symbol", "n"))
    return made.select("seq_id", "symbol", F.col("n").cast("long").alias("n"))


def _weight_sql(table_: dict[str, float], water: float) -> str:
    return f"round({water}::DOUBLE" + "".join(f" + (length(seq) - length(replace(seq, '{a}', ''))) * {w}::DOUBLE" for a, w in table_.items()) + ", 3)"


@query(
    f"SELECT doc_id AS seq_id, {_weight_sql(s.RESIDUE_WEIGHT, s.WATER)}::DOUBLE AS average, {_weight_sql(s.MONOISOTOPIC_WEIGHT, s.MONOISOTOPIC_WATER)}::DOUBLE AS monoisotopic FROM (SELECT doc_id, {PROT_SQL} AS seq FROM documents)"
)
def molecular_weight(spark, sf_dir):
    p = proteins(spark, sf_dir)
    return p.select("seq_id", F.round(s.molecular_weight(F.col("seq")), 3).alias("average"), F.round(s.molecular_weight(F.col("seq"), True), 3).alias("monoisotopic"))


@query(
    f"""SELECT doc_id AS seq_id, array_to_string(list_filter(range(0, length(seq) - 3), lambda i: seq[i + 1:i + 4] = 'ACAT'), ',') AS hits,
instr(seq, 'G') - 1 AS first_g, CASE WHEN instr(reverse(seq), 'G') = 0 THEN -1 ELSE length(seq) - instr(reverse(seq), 'G') END AS last_g
FROM (SELECT doc_id, {NUC_SQL} AS seq FROM documents)"""
)
def find_subsequence(spark, sf_dir):
    seq = F.col("seq")
    hits = F.array_join(F.transform(s.find_subsequence(seq, "ACAT"), lambda i: i.cast("string")), ",")
    return nucleotides(spark, sf_dir).select("seq_id", hits.alias("hits"), s.find_symbol_first(seq, "G").cast("long").alias("first_g"), s.find_symbol_last(seq, "G").cast("long").alias("last_g"))


def _codon_case(at: str, table: dict[str, str] | None = None) -> str:
    return "CASE " + at + "".join(f" WHEN '{c}' THEN '{a}'" for c, a in (table or s.codon_table()).items()) + " END"


@query(
    f"""SELECT doc_id AS seq_id, array_to_string(list_transform(range(0, length(seq) // 3), lambda i: {_codon_case('seq[3 * i + 1:3 * i + 3]')}), '') AS protein
FROM (SELECT doc_id, n[1:length(n) - length(n) % 3] AS seq FROM (SELECT doc_id, {NUC_SQL} AS n FROM documents))"""
)
def translate_complete(spark, sf_dir):
    whole = F.substring(F.col("seq"), F.lit(1), F.length("seq") - F.length("seq") % 3)
    return nucleotides(spark, sf_dir).select("seq_id", s.translate(whole).alias("protein"))


_MITO = codons.table(2)


@query(
    f"""SELECT doc_id AS seq_id, array_to_string(list_transform(range(0, length(seq) // 3), lambda i: {_codon_case('seq[3 * i + 1:3 * i + 3]', _MITO.codons)}), '') AS protein,
len(list_filter(range(0, length(seq) // 3), lambda i: seq[3 * i + 1:3 * i + 3] IN ({', '.join(f"'{c}'" for c in _MITO.starts)}))) AS n_starts
FROM (SELECT doc_id, n[1:length(n) - length(n) % 3] AS seq FROM (SELECT doc_id, {NUC_SQL} AS n FROM documents))"""
)
def translate_mitochondrial(spark, sf_dir):
    whole = F.substring(F.col("seq"), F.lit(1), F.length("seq") - F.length("seq") % 3)
    starts = F.size(F.filter(F.regexp_extract_all(whole, F.lit("(?s).{3}"), F.lit(0)), _MITO.is_start)).cast("long")
    return nucleotides(spark, sf_dir).select("seq_id", s.translate(whole, _MITO.codons).alias("protein"), starts.alias("n_starts"))


@query(
    f"""WITH n AS (SELECT doc_id AS seq_id, {NUC_SQL} AS seq FROM documents),
f AS (SELECT seq_id, seq, unnest([0, 1, 2]) AS f FROM n),
p AS (SELECT seq_id, f, list_transform(range(0, (length(seq) - f) // 3), lambda i: seq[f + 3 * i + 1:f + 3 * i + 3]) AS c FROM f WHERE length(seq) - f >= 3),
t AS (SELECT seq_id, f, c, array_to_string(list_transform(c, lambda x: {_codon_case('x')}), '') AS p FROM p),
o AS (SELECT seq_id, f, p, unnest(c) AS codon, unnest(range(0, len(c))) AS i FROM t),
r AS (SELECT seq_id, f + 3 * i AS start, p[i + 1:] AS rest FROM o WHERE codon IN {s.STANDARD_STARTS})
SELECT seq_id, start::BIGINT AS start, (start + 3 * length(protein))::BIGINT AS stop, protein
FROM (SELECT seq_id, start, CASE WHEN instr(rest, '*') > 0 THEN rest[1:instr(rest, '*')] ELSE rest END AS protein FROM r)"""
)
def orf_scan(spark, sf_dir):
    return orfs.orf_scan(nucleotides(spark, sf_dir)).select("seq_id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "protein")


# k-mers ---------------------------------------------------------------------------------


@query(f"WITH {_kmers_sql('documents', 'doc_id', 6)} SELECT kmer, count(*) AS n FROM km GROUP BY kmer")
def kmer_count(spark, sf_dir):
    return kmers.count_kmers(kmers.explode_kmers(nucleotides(spark, sf_dir), "ACGT", 6))


@query(f"WITH {_kmers_sql('documents', 'doc_id', 10)} SELECT n, count(*) AS kmers FROM (SELECT kmer, count(*) AS n FROM km GROUP BY kmer) GROUP BY n")
def kmer_spectrum(spark, sf_dir):
    return kmers.spectrum(kmers.explode_kmers(nucleotides(spark, sf_dir), "ACGT", 10))


@query(
    f"""WITH n AS (SELECT doc_id, {NUC_SQL} AS seq FROM documents),
p AS (SELECT seq, unnest(range(1, length(seq) - 2)) AS i FROM n WHERE length(seq) >= 4)
SELECT ((instr('ACGT', seq[i]) - 1) * 16 + (instr('ACGT', seq[i + 1]) - 1) * 4 + (instr('ACGT', seq[i + 3]) - 1))::BIGINT AS kmer, count(*) AS n FROM p GROUP BY 1"""
)
def spaced_kmer_count(spark, sf_dir):
    return kmers.count_kmers(kmers.explode_kmers(nucleotides(spark, sf_dir), "ACGT", 3, spacing="1101"))


@query(f"WITH {_kmers_sql('documents', 'doc_id', 6)} SELECT DISTINCT kmer, list_aggregate([{', '.join(f'''substr('ACGT', ((kmer // {4 ** (5 - i)}) % 4 + 1)::INT, 1)''' for i in range(6))}], 'string_agg', '') AS symbols FROM km")
def kmer_decode(spark, sf_dir):
    seen = kmers.explode_kmers(nucleotides(spark, sf_dir), "ACGT", 6).select("kmer").distinct()
    return seen.select("kmer", kmers.decode_kmer(F.col("kmer"), "ACGT", 6).alias("symbols"))


_MATCH = f"WITH {_kmers_sql('documents', 'doc_id', 12, 'd')}, {_kmers_sql('benchmark', 'item_id', 12, 'b')}"


@query(f"{_MATCH} SELECT d.id AS query_id, b.id AS ref_id, (b.pos - d.pos)::BIGINT AS diagonal, count(*) AS hits FROM d JOIN b USING (kmer) GROUP BY 1, 2, 3")
def kmer_match_pairs(spark, sf_dir):
    index = kmers.explode_kmers(nucleotides(spark, sf_dir, "benchmark", "item_id"), "ACGT", 12)
    hits = kmers.match(kmers.explode_kmers(nucleotides(spark, sf_dir), "ACGT", 12), index)
    return kmers.diagonals(hits).withColumn("diagonal", F.col("diagonal").cast("long"))


@query(f"{_MATCH} SELECT d.id AS query_id, b.id AS ref_id, count(*) AS matches FROM d JOIN b USING (kmer) GROUP BY 1, 2")
def kmer_match_counts(spark, sf_dir):
    index = kmers.explode_kmers(nucleotides(spark, sf_dir, "benchmark", "item_id"), "ACGT", 12)
    return kmers.match_counts(kmers.explode_kmers(nucleotides(spark, sf_dir), "ACGT", 12), index)


@query(f"WITH {_kmers_sql('documents', 'doc_id', 6)}, m AS (SELECT id, i - 1 AS pos FROM km_p WHERE seq[i] = 'G') SELECT kmer, count(*) AS n FROM km WHERE NOT EXISTS (SELECT 1 FROM km_s s WHERE s.id = km.id AND contains(s.seq[km.pos + 1:km.pos + 6], 'G')) GROUP BY kmer")
def kmer_count_masked(spark, sf_dir):
    return kmers.count_kmers(kmers.explode_kmers(nucleotides(spark, sf_dir), "ACGT", 6, masked="G"))


_SCORE = "CASE WHEN {a} = {b} THEN 2 WHEN ({a} + {b}) % 2 = 0 THEN 0 ELSE -1 END"


@query(
    f"""WITH {_kmers_sql('benchmark', 'item_id', 4)}, c AS (SELECT kmer, count(*) AS n FROM km GROUP BY kmer),
pairs AS (SELECT a.kmer, b.n, {' + '.join(_SCORE.format(a=f'((a.kmer // {4 ** i}) % 4)', b=f'((b.kmer // {4 ** i}) % 4)') for i in range(4))} AS score FROM (SELECT unnest(range(0, 256)) AS kmer) a, c b)
SELECT kmer::BIGINT AS kmer, sum(n)::BIGINT AS n FROM pairs WHERE score >= 5 GROUP BY kmer"""
)
def kmer_similar_counts(spark, sf_dir):
    codes = spark.range(4).select(F.col("id").alias("code1"))
    scores = codes.crossJoin(spark.range(4).select(F.col("id").alias("code2")))
    a, b = F.col("code1"), F.col("code2")
    scores = scores.withColumn("score", F.when(a == b, 2).when((a + b) % 2 == 0, 0).otherwise(-1))
    similar = kmers.similar_kmers("ACGT", 4, scores, 5)
    counts = kmers.count_kmers(kmers.explode_kmers(nucleotides(spark, sf_dir, "benchmark", "item_id"), "ACGT", 4))
    return counts.join(similar, counts["kmer"] == similar["similar"]).groupBy(similar["kmer"]).agg(F.sum("n").alias("n"))


@query(
    f"""WITH {_kmers_sql('documents', 'doc_id', 8)},
w AS (SELECT id, count(*) OVER f AS full_, min({{'r': kmer, 'p': pos}}) OVER f AS best FROM km WINDOW f AS (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
SELECT DISTINCT id AS ref_id, best.p::BIGINT AS pos, best.r AS kmer FROM w WHERE full_ = 10"""
)
def minimizers(spark, sf_dir):
    out = kmers.row_minimizers(nucleotides(spark, sf_dir), "ACGT", 8, 10)
    return out.select("ref_id", F.col("pos").cast("long").alias("pos"), "kmer")


@query(
    f"""WITH {_kmers_sql('documents', 'doc_id', 4, 'sm')}, {_kmers_sql('documents', 'doc_id', 8)},
w AS (SELECT id, pos, count(*) OVER f AS full_, min({{'r': kmer, 'p': pos}}) OVER f AS best FROM sm WINDOW f AS (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
SELECT km.id AS ref_id, km.pos::BIGINT AS pos, km.kmer FROM w JOIN km USING (id, pos) WHERE full_ = 5 AND best.p - w.pos IN (0, 4)"""
)
def syncmers(spark, sf_dir):
    out = kmers.syncmers(nucleotides(spark, sf_dir), "ACGT", 8, 4, offsets=(0, -1))
    return out.select("ref_id", F.col("pos").cast("long").alias("pos"), "kmer")


@query(f"WITH {_kmers_sql('documents', 'doc_id', 8)} SELECT id AS ref_id, pos::BIGINT AS pos, kmer FROM km WHERE kmer < 65536 / 16.0")
def mincode(spark, sf_dir):
    out = kmers.mincode(kmers.explode_kmers(nucleotides(spark, sf_dir), "ACGT", 8), 4**8, 16)
    return out.select("ref_id", F.col("pos").cast("long").alias("pos"), "kmer")


@query(
    f"""WITH {_kmers_sql('documents', 'doc_id', 6)}, c AS (SELECT kmer, count(*) AS n FROM km GROUP BY kmer),
f AS (SELECT k::BIGINT AS kmer, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 4096)) AS k) LEFT JOIN c ON k = kmer)
SELECT kmer, (row_number() OVER (ORDER BY n, kmer) - 1)::BIGINT AS rank FROM f"""
)
def frequency_permutation(spark, sf_dir):
    counts = kmers.count_kmers(kmers.explode_kmers(nucleotides(spark, sf_dir), "ACGT", 6))
    return kmers.frequency_order(counts, 4**6)


# Profiles and alignments ----------------------------------------------------------------


def _padded(spark, sf_dir):
    """Benchmark nucleotides, each padded with gaps to the longest."""
    rows = nucleotides(spark, sf_dir, "benchmark", "item_id")
    longest = rows.agg(F.max(F.length("seq")).alias("longest"))
    return rows.crossJoin(F.broadcast(longest)).select("seq_id", F.rpad("seq", F.col("longest"), F.lit(profiles.GAP)).alias("seq"))


_COLUMNS = f"""b AS (SELECT item_id, {NUC_SQL} AS seq FROM benchmark), p AS (SELECT seq, unnest(range(1, length(seq) + 1)) AS i FROM b),
c AS (SELECT i - 1 AS col, seq[i] AS symbol, count(*) AS n FROM p GROUP BY 1, 2)"""


@query(
    f"""WITH {_COLUMNS},
g AS (SELECT a.col, s.symbol, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT col FROM c) a CROSS JOIN (SELECT unnest(['A', 'C', 'G', 'T']) AS symbol) s LEFT JOIN c ON c.col = a.col AND c.symbol = s.symbol),
f AS (SELECT *, (n + 0.25) / (sum(n) OVER (PARTITION BY col) + 1) AS f FROM g)
SELECT col::BIGINT AS col, symbol, n::BIGINT AS n, round(f, 9)::DOUBLE AS p, round(log2(f / 0.25), 6)::DOUBLE AS log_odds FROM f"""
)
def profile_counts_whole(spark, sf_dir):
    """Counts and log-odds of each column over all letters of all items."""
    made = profiles.counts(_padded(spark, sf_dir), "ACGT")
    made = profiles.log_odds(profiles.probabilities(made, "ACGT", pseudocount=1), "ACGT")
    return made.select(F.col("col").cast("long").alias("col"), "symbol", "n", F.round("p", 9).alias("p"), F.round("log_odds", 6).alias("log_odds"))


@query(
    f"""WITH {_COLUMNS},
m AS (SELECT col, string_agg(symbol, '' ORDER BY symbol) AS best FROM (SELECT *, max(n) OVER (PARTITION BY col) AS top FROM c) WHERE n = top GROUP BY col)
SELECT string_agg(CASE best {' '.join(f"WHEN '{v}' THEN '{k}'" for k, v in {k: ''.join(sorted(v)) for k, v in s.IUPAC.items()}.items())} WHEN 'ACGT' THEN 'N' END, '' ORDER BY col) AS consensus FROM m"""
)
def profile_consensus_whole(spark, sf_dir):
    """The consensus over all letters of all items."""
    return profiles.consensus(profiles.counts(_padded(spark, sf_dir), "ACGT"))


@query(
    f"""WITH b AS (SELECT item_id, {PROT_SQL} AS seq FROM benchmark),
o AS (SELECT a.item_id AS id1, b.item_id AS id2, least(length(a.seq), length(b.seq)) AS n, len(list_filter(range(1, least(length(a.seq), length(b.seq)) + 1), lambda i: a.seq[i] = b.seq[i])) AS same FROM b a JOIN b ON a.item_id < b.item_id)
SELECT id1, id2, CASE WHEN n > 0 THEN round(same / n::DOUBLE, 6) END AS identity, same * 5 - (n - same) * 4 AS score FROM o"""
)
def ungapped_identity_whole(spark, sf_dir):
    """Identity and score over the whole overlap of each pair, without a least length; the identity of an empty overlap is null."""
    rows = proteins(spark, sf_dir, "benchmark", "item_id")
    a, b = rows.select(F.col("seq_id").alias("id1"), F.col("seq").alias("a")), rows.select(F.col("seq_id").alias("id2"), F.col("seq").alias("b"))
    pairs = a.join(F.broadcast(b), F.col("id1") < F.col("id2")).withColumn("n", F.least(F.length("a"), F.length("b")))
    pairs = pairs.withColumn("same", F.when(F.col("n") > 0, alignments.identical_columns(F.substring("a", F.lit(1), F.col("n")), F.substring("b", F.lit(1), F.col("n")))).otherwise(0))
    return pairs.select("id1", "id2", F.round(F.when(F.col("n") > 0, F.col("same") / F.col("n")), 6).alias("identity"), (F.col("same") * 5 - (F.col("n") - F.col("same")) * 4).cast("long").alias("score"))


@query(
    """WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, event_type ORDER BY i) AS island FROM e),
r AS (SELECT user_id, event_type, island, min(i) AS i, count(*) AS n FROM g GROUP BY 1, 2, 3)
SELECT user_id, string_agg(n || event_type[1:1], '' ORDER BY i) AS cigar FROM r GROUP BY user_id"""
)
def cigar_rle(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = e.select("user_id", place.alias("pos"), F.substring("event_type", 1, 1).alias("op0"), F.col("event_type").alias("op"))
    return alignments.run_lengths(rows, key="user_id", symbol="op", shown="op0")


@query(
    f"""SELECT doc_id AS seq_id, round(log10(0.041 * length(seq) * (SELECT sum(length({PROT_SQL})) FROM benchmark)) - 0.267 * (length(seq) // 10) / ln(10), 6)::DOUBLE AS log_evalue
FROM (SELECT doc_id, {PROT_SQL} AS seq FROM documents) WHERE length(seq) > 0"""
)
def evalues(spark, sf_dir):
    total = proteins(spark, sf_dir, "benchmark", "item_id").agg(F.sum(F.length("seq")).alias("total"))
    p = proteins(spark, sf_dir).where("length(seq) > 0").crossJoin(F.broadcast(total))
    score = F.floor(F.length("seq") / 10)
    return p.select("seq_id", F.round(alignments.log_evalue(score, F.length("seq"), F.col("total"), lam=0.267, k=0.041), 6).alias("log_evalue"))


@query(
    f"""WITH RECURSIVE t AS (SELECT item_id, string_split({PROT_SQL}, '') AS s, length({PROT_SQL}) AS n FROM benchmark),
pr AS (SELECT a.item_id AS id1, a.s AS s1, a.n AS n1, b.s AS s2, b.n AS n2 FROM t a JOIN t b ON b.item_id = a.item_id + 1),
dp(id1, i, m, x, y) AS (
  SELECT id1, 0, list_transform(range(0, n2 + 1), lambda j: CASE WHEN j = 0 THEN 0 ELSE -1000000000 END), list_transform(range(0, n2 + 1), lambda j: -1000000000),
         list_transform(range(0, n2 + 1), lambda j: CASE WHEN j = 0 THEN -1000000000 ELSE -10 - (j - 1) END)
  FROM pr
  UNION ALL
  SELECT id1, i + 1, nm, nx, list_transform(range(0, n2 + 1), lambda j: CASE WHEN j = 0 THEN -1000000000 ELSE list_max(list_transform(range(0, j), lambda k: nm[k + 1] - 10 - (j - k - 1))) END)
  FROM (SELECT dp.id1, i, n2, list_transform(range(0, n2 + 1), lambda j: CASE WHEN j = 0 THEN -1000000000 ELSE greatest(m[j], x[j], y[j]) + CASE WHEN s1[i + 1] = s2[j] THEN 5 ELSE -4 END END) AS nm,
               list_transform(range(0, n2 + 1), lambda j: CASE WHEN j = 0 THEN -10 - i ELSE greatest(m[j + 1] - 10, x[j + 1] - 1) END) AS nx
        FROM dp JOIN pr ON pr.id1 = dp.id1 WHERE i < n1))
SELECT dp.id1, greatest(m[-1], x[-1], y[-1])::BIGINT AS score FROM dp JOIN pr ON pr.id1 = dp.id1 WHERE i = n1"""
)
def optimal_align_score(spark, sf_dir):
    """Every pair of benchmark items' neighbours in id: global affine scores."""
    rows = proteins(spark, sf_dir, "benchmark", "item_id")
    pairs = rows.select(F.col("seq_id").alias("id1"), F.col("seq").alias("seq1")).join(rows.select((F.col("seq_id") - 1).alias("id1"), F.col("seq").alias("seq2")), "id1")
    return pairs.select("id1", alignments.align_score(F.col("seq1"), F.col("seq2"), match=5, mismatch=-4, gap=(-10, -1)).alias("score"))


_OFF = "CASE WHEN j - (i + 1) NOT BETWEEN -60 AND 60 THEN -1000000000 ELSE {} END"


@query(
    f"""WITH RECURSIVE t AS (SELECT item_id, string_split({PROT_SQL}, '') AS s, length({PROT_SQL}) AS n FROM benchmark),
pr AS (SELECT a.item_id AS id1, a.s AS s1, a.n AS n1, b.s AS s2, b.n AS n2 FROM t a JOIN t b ON b.item_id = a.item_id + 1),
dp(id1, i, m, x, y, best) AS (
  SELECT id1, 0, list_transform(range(0, n2 + 1), lambda j: 0), list_transform(range(0, n2 + 1), lambda j: -1000000000), list_transform(range(0, n2 + 1), lambda j: -1000000000), 0 FROM pr
  UNION ALL
  SELECT id1, i + 1, nm, nx, list_transform(range(0, n2 + 1), lambda j: CASE WHEN j = 0 THEN -1000000000 ELSE {_OFF.format("list_max(list_transform(range(0, j), lambda k: CASE WHEN nm[k + 1] - 10 - (j - k - 1) > 0 THEN nm[k + 1] - 10 - (j - k - 1) ELSE -1000000000 END))")} END), greatest(best, list_max(nm))
  FROM (SELECT dp.id1, i, n2, best, list_transform(range(0, n2 + 1), lambda j: CASE WHEN j = 0 THEN 0 ELSE {_OFF.format("greatest(0, greatest(m[j], x[j], y[j]) + CASE WHEN s1[i + 1] = s2[j] THEN 5 ELSE -4 END)")} END) AS nm,
               list_transform(range(0, n2 + 1), lambda j: CASE WHEN j = 0 THEN -1000000000 ELSE {_OFF.format("CASE WHEN greatest(m[j + 1] - 10, x[j + 1] - 1) > 0 THEN greatest(m[j + 1] - 10, x[j + 1] - 1) ELSE -1000000000 END")} END) AS nx
        FROM dp JOIN pr ON pr.id1 = dp.id1 WHERE i < n1))
SELECT dp.id1, best::BIGINT AS score FROM dp JOIN pr ON pr.id1 = dp.id1 WHERE i = n1"""
)
def banded_align_score(spark, sf_dir):
    rows = proteins(spark, sf_dir, "benchmark", "item_id")
    pairs = rows.select(F.col("seq_id").alias("id1"), F.col("seq").alias("seq1")).join(rows.select((F.col("seq_id") - 1).alias("id1"), F.col("seq").alias("seq2")), "id1")
    return pairs.select("id1", alignments.align_score(F.col("seq1"), F.col("seq2"), match=5, mismatch=-4, gap=(-10, -1), band=(-60, 60), local=True).alias("score"))


@query(
    f"""WITH d AS (SELECT doc_id AS id, {NUC_SQL} AS seq FROM documents), b AS (SELECT item_id AS id, {NUC_SQL} AS seq FROM benchmark),
dk AS (SELECT id, i, substr(seq, i, 12) AS w, CASE WHEN i = 1 THEN '^' ELSE seq[i - 1] END AS was FROM (SELECT *, unnest(range(1, length(seq) - 10)) AS i FROM d WHERE length(seq) >= 12)),
bk AS (SELECT id, i, substr(seq, i, 12) AS w, CASE WHEN i = 1 THEN '$' ELSE seq[i - 1] END AS was FROM (SELECT *, unnest(range(1, length(seq) - 10)) AS i FROM b WHERE length(seq) >= 12)),
h AS (SELECT row_number() OVER () AS hit, dk.id AS q, bk.id AS r, dk.i AS u, bk.i AS v FROM dk JOIN bk USING (w) WHERE dk.was <> bk.was),
l AS (SELECT h.*, d.seq AS s1, b.seq AS s2 FROM h JOIN d ON d.id = q JOIN b ON b.id = r),
steps AS (
  SELECT hit, 1 AS side, k, CASE WHEN s1[u + k] = s2[v + k] THEN 1 ELSE -1 END AS s FROM (SELECT *, unnest(range(1, least(length(s1) - u, length(s2) - v) + 1)) AS k FROM l)
  UNION ALL
  SELECT hit, 0, k, CASE WHEN s1[u - k] = s2[v - k] THEN 1 ELSE -1 END FROM (SELECT *, unnest(range(1, least(u, v))) AS k FROM l)),
sums AS (SELECT hit, side, k, sum(s) OVER (PARTITION BY hit, side ORDER BY k) AS total FROM steps),
tops AS (SELECT *, greatest(0, max(total) OVER (PARTITION BY hit, side ORDER BY k)) - total > 20 AS over FROM sums),
ends AS (SELECT hit, side, min(k) FILTER (over) AS stop FROM tops GROUP BY 1, 2),
best AS (SELECT hit, side, max(total) AS score, max(k) AS n FROM (SELECT t.*, max(total) OVER (PARTITION BY t.hit, t.side) AS top FROM tops t JOIN ends USING (hit, side) WHERE stop IS NULL OR k < stop) WHERE total = top AND top >= 0 GROUP BY 1, 2),
done AS (SELECT q, r, 1 + coalesce(a.score, 0) + coalesce(c.score, 0) AS score, u - 1 - coalesce(c.n, 0) AS start1, v - 1 - coalesce(c.n, 0) AS start2, 1 + coalesce(a.n, 0) + coalesce(c.n, 0) AS length
  FROM h LEFT JOIN best a ON a.hit = h.hit AND a.side = 1 LEFT JOIN best c ON c.hit = h.hit AND c.side = 0)
SELECT q AS query_id, r AS ref_id, score::BIGINT AS score, start1::BIGINT AS start1, start2::BIGINT AS start2, length::BIGINT AS length
FROM (SELECT *, row_number() OVER (PARTITION BY q, r ORDER BY score DESC, start1, start2, length) AS place FROM done) WHERE place = 1"""
)
def seed_extension(spark, sf_dir):
    """The best ungapped X-drop extension of each pair's 12-mer hits, on all diagonals, between documents and benchmark.

    Hits in one run of matches extend alike, so the first of each run stands for them.
    """
    ref = nucleotides(spark, sf_dir, "benchmark", "item_id")
    docs = nucleotides(spark, sf_dir)
    hits = kmers.match_runs(docs, ref, "ACGT", 12)
    seeds = hits.groupBy("query_id", "ref_id").agg(F.collect_list(F.array("query_pos", "ref_pos")).alias("seeds"))
    pairs = seeds.join(docs.select(F.col("seq_id").alias("query_id"), F.col("seq").alias("seq1")), "query_id").join(ref.select(F.col("seq_id").alias("ref_id"), F.col("seq").alias("seq2")), "ref_id")
    return pairs.select("query_id", "ref_id", alignments.extend_best(F.col("seq1"), F.col("seq2"), F.col("seeds"), threshold=20).alias("x")).select("query_id", "ref_id", "x.*")


# Annotations ----------------------------------------------------------------------------

_FEATURES = """f AS (SELECT user_id, event_id AS feature_id, event_type AS key, (floor(epoch(ts))::BIGINT // 60) % 20000 AS first, (floor(epoch(ts))::BIGINT // 60) % 20000 + floor(abs(value))::BIGINT AS last FROM events)"""


def _features(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    first = F.floor(F.unix_timestamp("ts") / 60) % 20000
    return e.select("user_id", F.col("event_id").alias("feature_id"), F.col("event_type").alias("key"), first.alias("first"), (first + F.floor(F.abs("value"))).alias("last"))


@query(
    f"""WITH {_FEATURES} SELECT user_id, feature_id, key, greatest(first, 5000) AS first, least(last, 9999) AS last,
(CASE WHEN first < 5000 THEN 1 ELSE 0 END + CASE WHEN last > 9999 THEN 2 ELSE 0 END)::BIGINT AS defect FROM f WHERE first <= 9999 AND last >= 5000"""
)
def annotation_slice(spark, sf_dir):
    return annotations.cut(_features(spark, sf_dir), 5000, 10000).select("user_id", "feature_id", "key", "first", "last", F.col("defect").cast("long").alias("defect"))


@query(f"WITH {_FEATURES} SELECT a.user_id, a.feature_id, count(*) AS overlaps FROM f a JOIN f b ON a.user_id = b.user_id AND a.feature_id <> b.feature_id AND a.first <= b.last AND b.first <= a.last GROUP BY 1, 2")
def feature_overlaps(spark, sf_dir):
    return annotations.overlap_counts(_features(spark, sf_dir), key="user_id", width=64)

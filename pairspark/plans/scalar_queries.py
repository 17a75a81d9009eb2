"""Queries for ids, sequence cleaning, encoders and scalar maths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chemistry as chem
from ..functions import fixed_values as fv
from ..functions import numeric as num
from ..functions import text as tx
from ..functions import vectors as vec
from ..operators.graph import bond_edges
from ..operators.screening import Heads, apply_heads, assign_pair_id
from ..operators.structure import family_flags
from ..operators.tables import normalize_table
from .registry import query, table
from .views import SEQ_SQL, line_key, lines, sequences


@query("assign_pair_id", """
  SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN 'doc' || doc_id END,
         'PAIR_' || (row_number() OVER (ORDER BY doc_id) - 1)) AS "ID" FROM documents
""")
def assign_pair_id_query(spark, folder):
    docs = table(spark, folder, "documents", "doc_id")
    given = docs.withColumn("ID", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("doc"), "doc_id")))
    return assign_pair_id(given, "doc_id")


SAFE_SQL = """CASE WHEN NOT contains(regexp_replace(url, '[/\\\\:*?"<>|]', '_', 'g'), '..')
  AND replace(regexp_replace(url, '[/\\\\:*?"<>|]', '_', 'g'), '.', '') <> ''
  THEN regexp_replace(url, '[/\\\\:*?"<>|]', '_', 'g') END"""


@query("safe_id", f"SELECT page_id, {SAFE_SQL} AS safe FROM pages")
def safe_id_query(spark, folder):
    return table(spark, folder, "pages").select("page_id", tx.safe_id(F.col("url"), strict=False).alias("safe"))


@query("pair_key", f"SELECT page_id, {SAFE_SQL} || '__' || sha256(html) AS pair_key FROM pages")
def pair_key_query(spark, folder):
    return table(spark, folder, "pages").select("page_id", tx.pair_key(F.col("url"), F.col("html"), strict=False).alias("pair_key"))


@query("clean_sequence_strict", """
  SELECT doc_id, md5(c) AS digest, length(c) - length(replace(c, 'X', '')) AS unknown
  FROM (SELECT doc_id, regexp_replace(text, '[^ACDEFGHIKLMNPQRSTVWY]', 'X', 'g') AS c FROM documents)
""")
def clean_sequence_strict(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text").select("doc_id", tx.clean_sequence(F.col("text")).alias("c"))
    unknown = F.length("c") - F.length(F.replace("c", F.lit("X"), F.lit("")))
    return docs.select("doc_id", F.md5("c").alias("digest"), unknown.cast("long").alias("unknown"))


@query("clean_sequence_basic", f"""
  WITH {SEQ_SQL} SELECT doc_id, md5(translate(seq, 'UB', 'XX')) AS digest FROM seqs
""")
def clean_sequence_basic(spark, folder):
    return sequences(spark, folder).select("doc_id", F.md5(tx.clean_sequence(F.col("seq"), "basic")).alias("digest"))


@query("normalize_table", """
  WITH a AS (SELECT p_brand AS key, avg(p_retailprice) AS raw FROM part GROUP BY 1),
       m AS (SELECT min(raw) AS lo, max(raw) AS hi FROM a)
  SELECT key, round((raw - lo) / (hi - lo), 6) AS value FROM a, m
  UNION ALL SELECT 'X', round((lo + hi) / 2, 6) FROM m
""")
def normalize_table_query(spark, folder):
    prices = table(spark, folder, "part").groupBy(F.col("p_brand").alias("key")).agg(F.avg("p_retailprice").alias("raw"))
    return normalize_table(prices, "key", "raw", "value").select("key", F.round("value", 6).alias("value"))


def _values_sql() -> str:
    rows = []
    for place, letter in enumerate(fv.RESIDUES):
        groups = ", ".join(str(int(letter in members)) for members in fv.RESIDUE_GROUPS.values())
        properties = ", ".join(f"{chem.normalized_property(name)[place]!r}::DOUBLE" for name in fv.RESIDUE_PROPERTIES)
        rows.append(f"('{letter}', {groups}, {properties})")
    names = ", ".join(["aa", *fv.RESIDUE_GROUPS, *fv.RESIDUE_PROPERTIES])
    return f"props({names}) AS (VALUES {', '.join(rows)})"


@query("residue_features", f"""
  WITH {SEQ_SQL}, {_values_sql()},
  res AS (SELECT doc_id, unnest(string_split(translate(seq, 'UB', 'XX'), '')) AS aa FROM seqs WHERE seq <> '')
  SELECT doc_id, count(*) AS residues, CAST(sum(CASE WHEN res.aa = 'X' THEN 1 ELSE 0 END) AS BIGINT) AS unknown,
    {", ".join(f"CAST(sum({g}) AS BIGINT) AS {g}" for g in fv.RESIDUE_GROUPS)},
    {", ".join(f"round(sum({p}), 5) AS {p}" for p in fv.RESIDUE_PROPERTIES)}
  FROM res JOIN props USING (aa) GROUP BY doc_id
""")
def residue_features_query(spark, folder):
    """Feature vectors of all residues, summed per sequence."""
    seqs = sequences(spark, folder).select("doc_id", tx.clean_sequence(F.col("seq"), "basic").alias("seq")).where("seq <> ''")
    counts = chem.letter_counts(F.col("seq"))
    counted = seqs.select("doc_id", F.length("seq").alias("residues"), *[c.alias(f"n_{letter}") for letter, c in counts.items()])
    totals = chem.residue_totals({letter: F.col(f"n_{letter}") for letter in counts})
    per_row = counted.select("doc_id", "residues", F.col("n_X").alias("unknown"), *[c.alias(name) for name, c in totals.items()])
    return per_row.groupBy("doc_id").agg(
        F.sum("residues").alias("residues"), F.sum("unknown").alias("unknown"),
        *[F.sum(name).alias(name) for name in fv.RESIDUE_GROUPS], *[F.round(F.sum(name), 5).alias(name) for name in fv.RESIDUE_PROPERTIES])


@query("residue_vector", f"""
  WITH {SEQ_SQL}, {_values_sql()}, letters AS (SELECT aa, row_number() OVER () AS i FROM props),
  head AS (SELECT doc_id, unnest(string_split(translate(seq, 'UB', 'XX'), '')) AS aa FROM seqs WHERE seq <> '')
  SELECT aa, count(*) AS n, strpos('{fv.RESIDUES}', aa) - 1 AS hot, round(any_value(weight), 6) AS weight, 33 AS width
  FROM head JOIN props USING (aa) GROUP BY aa
""")
def residue_vector(spark, folder):
    """The whole 33-wide vector per residue: width, hot place and the first property."""
    seqs = sequences(spark, folder).select(tx.clean_sequence(F.col("seq"), "basic").alias("seq")).where("seq <> ''")
    residues = seqs.select(F.explode(F.split("seq", "")).alias("aa")).groupBy("aa").agg(F.count(F.lit(1)).alias("n"))
    held = residues.select("aa", "n", chem.residue_features(F.col("aa")).alias("v"))
    return held.select("aa", "n", (F.array_position("v", F.lit(1.0)) - 1).alias("hot"),
                       F.round(F.get("v", F.lit(26)), 6).alias("weight"), F.size("v").alias("width"))


HYBRID = ["SP", "SP2", "SP3", "SP3D", "SP3D2", "S", "D"]


def _flags_sql(expr: str, values: str) -> str:
    return f"list_transform({values}, lambda v: CASE WHEN v = {expr} THEN 1 ELSE 0 END)"


@query("atom_features", f"""
  SELECT {line_key()} AS line_key, array_to_string(
    {_flags_sql("l_linenumber", "range(0, 11)")}
    || {_flags_sql("least(CAST(l_quantity AS BIGINT) % 13, 10)", "range(0, 11)")}
    || {_flags_sql("least(l_partkey % 15, 10)", "range(0, 11)")}
    || list_transform({fv.HYBRIDIZATIONS_FULL}, lambda v: CASE WHEN v =
         CASE WHEN list_contains({fv.HYBRIDIZATIONS_FULL[:5]}, ({HYBRID})[l_suppkey % 7 + 1]) THEN ({HYBRID})[l_suppkey % 7 + 1] ELSE 'other' END THEN 1 ELSE 0 END)
    || [CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END]
    || CASE l_returnflag WHEN 'N' THEN [0, 0] WHEN 'R' THEN [1, 0] ELSE [0, 1] END
    || [CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END], '') AS flags
  FROM lineitem
""")
def atom_features_query(spark, folder):
    """CIP code R from flag R, absent for flag N, an unknown code (read as S) for flag A."""
    hybrid = F.get(F.array(*[F.lit(h) for h in HYBRID]), (F.col("l_suppkey") % 7).cast("int"))
    flags = chem.atom_features(
        F.col("l_linenumber"), (F.col("l_quantity").cast("long") % 13).cast("int"), (F.col("l_partkey") % 15).cast("int"), hybrid,
        F.col("l_linestatus") == "O", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")), F.col("l_discount") > 0.05)
    return lines(spark, folder).select("line_key", F.concat_ws("", flags.cast("array<string>")).alias("flags"))


METALS = sorted(n for low, high in fv.METAL_RANGES for n in range(low, high + 1))


def _class_sql(z: str, separate: bool) -> str:
    cases = [f"WHEN {z} = {numbers[0]} THEN {i}" for i, (_, numbers) in enumerate(fv.ATOM_CLASSES, 1)]
    if separate:
        cases += [f"WHEN {z} = {numbers[0]} THEN {i}" for i, (_, numbers) in enumerate(fv.HALOGENS, 8)]
    else:
        cases.append(f"WHEN {z} IN (9, 17, 35, 53) THEN 8")
    cases.append(f"WHEN {z} IN ({', '.join(map(str, METALS))}) THEN {12 if separate else 9}")
    return "CASE " + " ".join(cases) + " ELSE 0 END"


@query("atom_class", f"""
  SELECT p_partkey, CAST({_class_sql("p_size", False)} AS INTEGER) AS cls, CAST({_class_sql("p_size * 2 + 1", True)} AS INTEGER) AS fine
  FROM part
""")
def atom_class_query(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey", chem.atom_class(F.col("p_size")).alias("cls"), chem.atom_class(F.col("p_size") * 2 + 1, True).alias("fine"))


SYMBOL_SQL = "CASE WHEN p_size % 2 = 0 THEN upper(substr(p_name, 1, 1)) ELSE upper(substr(p_name, 1, 1)) || substr(p_name, 2, 1) END"


@query("symbol_class", f"""
  SELECT p_partkey, CAST(CASE WHEN list_position({fv.ATOM_SYMBOLS}, s) > 0 THEN list_position({fv.ATOM_SYMBOLS}, s) - 1 ELSE 43 END AS INTEGER) AS cls
  FROM (SELECT p_partkey, {SYMBOL_SQL} AS s FROM part)
""")
def symbol_class_query(spark, folder):
    return table(spark, folder, "part").select("p_partkey", chem.symbol_class(F.expr(SYMBOL_SQL)).alias("cls"))


BASE_HYBRID = ["S", "SP", "SP2", "SP3", "SP3D", "SP3D2", "UNSPECIFIED"]


@query("base_atom_features", f"""
  WITH flags AS (SELECT l_orderkey AS g, l_linenumber AS node,
      max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS "Donor", max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS "Acceptor",
      max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS "Hydrophobe" FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2)
  SELECT {line_key()} AS line_key, array_to_string(
      [CAST(l_linenumber AS BIGINT), l_suppkey % 5] || {_flags_sql(f"({BASE_HYBRID})[l_partkey % 7 + 1]", str(BASE_HYBRID[:6]))}
      || [l_suppkey % 2, l_partkey % 3 - 1, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END], ',') AS features,
    coalesce("Donor", 0) AS "Donor", coalesce("Acceptor", 0) AS "Acceptor", coalesce("Hydrophobe", 0) AS "Hydrophobe", 0 AS "LumpedHydrophobe"
  FROM lineitem LEFT JOIN flags ON l_orderkey = g AND l_linenumber = node
""")
def base_atom_features_query(spark, folder):
    atoms = lines(spark, folder).withColumn("g", F.col("l_orderkey")).withColumn("node", F.col("l_linenumber"))
    hybrid = F.get(F.array(*[F.lit(h) for h in BASE_HYBRID]), (F.col("l_partkey") % 7).cast("int"))
    base = chem.base_atom_features(
        F.col("l_linenumber"), F.col("l_suppkey") % 5, hybrid, F.col("l_suppkey") % 2, F.col("l_partkey") % 3 - 1,
        F.col("l_linestatus") == "O", F.col("l_returnflag") == "R")
    family = F.when(F.col("l_returnflag") == "A", "Donor").when(F.col("l_returnflag") == "N", "Acceptor").otherwise("Hydrophobe")
    features = atoms.where("l_linestatus = 'O'").select("g", family.alias("family"), F.array("node").alias("atoms"))
    joined = family_flags(atoms.select("g", "node", "line_key", F.concat_ws(",", base.cast("array<string>")).alias("features")), features)
    return joined.select("line_key", "features", *fv.FEATURE_FAMILIES)


@query("one_hot", f"""
  SELECT event_id, array_to_string({_flags_sql("event_type", "['click','error','view']")}, '') AS zero,
    array_to_string({_flags_sql("CASE WHEN event_type IN ('click','error') THEN event_type ELSE 'view' END", "['click','error','view']")}, '') AS last,
    array_to_string({_flags_sql("user_id % 4", "range(0, 4)")}, '') AS strict,
    array_to_string({_flags_sql("event_id % 5", "range(0, 5)")}, '') AS indexed
  FROM events
""")
def one_hot_query(spark, folder):
    kinds = ["click", "error", "view"]

    def show(column, name):
        return F.concat_ws("", column.cast("array<string>")).alias(name)

    return table(spark, folder, "events").select(
        "event_id", show(vec.one_hot(F.col("event_type"), kinds, "zero"), "zero"),
        show(vec.one_hot(F.col("event_type"), kinds, "last"), "last"),
        show(vec.one_hot((F.col("user_id") % 4).cast("int"), [0, 1, 2, 3], "error"), "strict"),
        show(vec.one_hot_index((F.col("event_id") % 5).cast("int"), 5), "indexed"))


KIND_SQL = "CASE l_returnflag WHEN 'A' THEN 'AROMATIC' WHEN 'N' THEN 'SINGLE' ELSE 'DOUBLE' END"


@query("bond_edges", """
  WITH b AS (SELECT l_orderkey AS g, l_linenumber - 1 AS a, l_linenumber AS b,
                    CASE l_returnflag WHEN 'A' THEN 4 WHEN 'N' THEN 1 ELSE 2 END AS code FROM lineitem)
  SELECT 'plain' AS ids, g, a AS src, b AS dst, code FROM b UNION ALL SELECT 'plain', g, b, a, code FROM b
  UNION ALL SELECT 'shifted', g, (a + 7) % 8, (b + 7) % 8, code FROM b UNION ALL SELECT 'shifted', g, (b + 7) % 8, (a + 7) % 8, code FROM b
""")
def bond_edges_query(spark, folder):
    bonds = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("g"), (F.col("l_linenumber") - 1).alias("begin"), F.col("l_linenumber").alias("end"), F.expr(KIND_SQL).alias("kind"))
    sizes = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("g")).distinct().withColumn("n", F.lit(8))
    plain = bond_edges(bonds).withColumn("ids", F.lit("plain"))
    return plain.unionByName(bond_edges(bonds, sizes, legacy_shift=True).withColumn("ids", F.lit("shifted")))


@query("rbf", """
  WITH d AS (SELECT l_linenumber AS line, least(l_quantity / 2, 20.0) AS d FROM lineitem),
       c AS (SELECT i, i * 20.0 / 15 AS mu FROM range(0, 16) t(i))
  SELECT line, CAST(i AS INTEGER) AS centre, round(avg(exp(-power((d - mu) / 1.25, 2))), 6) AS value FROM d, c GROUP BY line, i
""")
def rbf_query(spark, folder):
    spread = table(spark, folder, "lineitem").select(
        F.col("l_linenumber").alias("line"), F.posexplode(vec.rbf(F.col("l_quantity") / 2)).alias("centre", "v"))
    return spread.groupBy("line", "centre").agg(F.round(F.avg("v"), 6).alias("value"))


LOGITS_SQL = "[embedding[1]::DOUBLE * 10, embedding[2]::DOUBLE * 10, embedding[3]::DOUBLE * 10]"


@query("activations", f"""
  WITH l AS (SELECT vec_id, embedding[4]::DOUBLE * 10 AS z, {LOGITS_SQL} AS x FROM embeddings),
  e AS (SELECT vec_id, z, x, list_transform(x, lambda v: exp(v - list_max(x))) AS e FROM l),
  p AS (SELECT vec_id, z, x, list_transform(e, lambda v: v / list_sum(e)) AS p FROM e)
  SELECT vec_id, 0.0::DOUBLE AS prediction, round(1 / (1 + exp(-z)), 4) AS predicted_binary_interaction, round(p[3], 4) AS predicted_agonist,
         round(p[1], 4) AS predicted_antagonist, round(p[2], 4) AS predicted_nonbinder,
         CAST(list_position(x, list_max(x)) - 1 AS INTEGER) AS best
  FROM p
""")
def activations(spark, folder):
    logits = F.array(*[F.get("embedding", F.lit(i)).cast("double") * 10 for i in range(3)])
    raw = table(spark, folder, "embeddings").select(
        "vec_id", F.lit(None).cast("double").alias("__reg"), (F.get("embedding", F.lit(3)).cast("double") * 10).alias("__logit"), logits.alias("__logits"))
    heads = Heads(regression=False, classification=True, multiclass=True)
    raw = raw.withColumn("best", vec.argmax(F.col("__logits")))
    scored = apply_heads(raw, ["vec_id", "best"], heads)
    return scored.select("vec_id", "best", *[F.round(c, 4).alias(c) for c in heads.score_columns()])


RAW_LABEL_SQL = "CASE WHEN user_id % 10 = 0 THEN 999 ELSE CAST(user_id % 3 AS INTEGER) - 1 END"


@query("shift_label", f"""
  SELECT label, label BETWEEN 0 AND 2 AS valid, label = 1000 AS unknown, count(*) AS n
  FROM (SELECT {RAW_LABEL_SQL} + 1 AS label FROM events) GROUP BY label
""")
def shift_label_query(spark, folder):
    labels = table(spark, folder, "events").select(num.shift_label(F.expr("IF(user_id % 10 = 0, 999, CAST(user_id % 3 AS INT) - 1)")).alias("label"))
    counted = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("label", num.is_valid_class(F.col("label"), 3).alias("valid"), num.is_unknown_effect(F.col("label")).alias("unknown"), "n")


@query("display_columns", """
  WITH p AS (SELECT p_partkey, p_size / 5.0 AS a, [p_size % 7, p_partkey % 7, (p_size + p_partkey) % 7] AS probs FROM part)
  SELECT p_partkey AS pair, round((4 + power(2, greatest(4, least(10, a)) - 4)) * 1.5, 6) AS size,
         (['antagonist','nonbinder','agonist'])[list_position(probs, list_max(probs))] AS effect,
         (['square','circle','triangle'])[list_position(probs, list_max(probs))] AS shape
  FROM p
""")
def display_columns(spark, folder):
    probs = F.array(F.col("p_size") % 7, F.col("p_partkey") % 7, (F.col("p_size") + F.col("p_partkey")) % 7)
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("pair"), F.round(num.display_size(F.col("p_size") / 5, 1.5), 6).alias("size"),
        num.display_class(probs, ["antagonist", "nonbinder", "agonist"]).alias("effect"),
        num.display_class(probs, ["square", "circle", "triangle"]).alias("shape"))


@query("score_for_display", """
  SELECT event_id, greatest(0.01, least(0.99, round(floor(value * 100) / 25600, 2))) AS shown FROM events
""")
def score_for_display_query(spark, folder):
    return table(spark, folder, "events").select("event_id", num.score_for_display(F.floor(F.col("value") * 100) / 25600).alias("shown"))


@query("length_bin", """
  WITH b AS (SELECT doc_id, n_chars, CASE WHEN n_chars <= 300 THEN 'short_300' WHEN n_chars <= 500 THEN 'medium_500'
                    WHEN n_chars <= 700 THEN 'long_700' ELSE 'sliding' END AS bin FROM documents),
  m AS (SELECT bin, max(n_chars) AS longest, count(*) AS n FROM b GROUP BY bin)
  SELECT bin, longest, n, CASE WHEN longest <= 300 THEN 8 WHEN longest <= 500 THEN 4 WHEN longest <= 700 THEN 2 ELSE 1 END AS batch_size FROM m
""")
def length_bin_query(spark, folder):
    docs = table(spark, folder, "documents", "n_chars").withColumn("bin", tx.length_bin(F.col("n_chars")))
    bins = docs.groupBy("bin").agg(F.max("n_chars").alias("longest"), F.count(F.lit(1)).alias("n"))
    return bins.select("bin", "longest", "n", tx.batch_size_for_length(F.col("longest")).alias("batch_size"))


NAMES = ["ALA", "GLY", "MSE", "SEC", "UNK", "TRP", "HIS", "ABC", "TYR", "ASX"]


@query("residue_code", f"""
  SELECT c_custkey, CASE ({NAMES})[c_custkey % 10 + 1] WHEN 'ALA' THEN 'A' WHEN 'GLY' THEN 'G' WHEN 'MSE' THEN 'M' WHEN 'SEC' THEN 'C'
    WHEN 'TRP' THEN 'W' WHEN 'HIS' THEN 'H' WHEN 'TYR' THEN 'Y' WHEN 'ASX' THEN 'B' ELSE 'X' END AS code FROM customer
""")
def residue_code_query(spark, folder):
    name = F.get(F.array(*[F.lit(n) for n in NAMES]), (F.col("c_custkey") % 10).cast("int"))
    return table(spark, folder, "customer").select("c_custkey", tx.residue_code(name).alias("code"))


@query("angle", """
  SELECT p_partkey, round(acos(greatest(-1, least(1, (a * a + b * b - c * c) / (2 * a * b)))), 6) AS angle
  FROM (SELECT p_partkey, p_size * 1.0 AS a, p_size % 7 + 1.0 AS b, p_partkey % 50 + 1.0 AS c FROM (SELECT p_partkey, p_size::DOUBLE AS p_size FROM part))
""")
def angle_query(spark, folder):
    size = F.col("p_size").cast("double")
    return table(spark, folder, "part").select(
        "p_partkey", F.round(num.angle(size, size % 7 + 1, F.col("p_partkey") % 50 + F.lit(1.0)), 6).alias("angle"))


COMPLEX_SQL = """
  c AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(upper(replace(replace(regexp_replace(text, '[^ -~\\n]', '', 'g'), '.', '/'), '/', ':')),
        '[^A-Z:]', '', 'g'), ':+', ':', 'g'), '^:|:$', '', 'g') AS chains, text FROM conversations)
"""


@query("clean_complex", f"""
  WITH {COMPLEX_SQL}
  SELECT conv_id, turn, md5(chains) AS digest, CASE WHEN len(string_split(chains, ':')) = 1 THEN 'mono'
      WHEN len(list_distinct(string_split(chains, ':'))) = 1 THEN 'homo' ELSE 'hetero' END AS mode,
    length(replace(chains, ':', '')) AS length, substr(regexp_replace(text, '[^A-Za-z0-9_]', '', 'g'), 1, 50) AS job,
    'job_' || substr(sha1(chains), 1, 5) AS job_id
  FROM c
""")
def clean_complex_query(spark, folder):
    """Sentences of a turn as chains."""
    ascii_text = F.regexp_replace("text", "[^ -~\n]", "")
    turns = table(spark, folder, "conversations").select(
        "conv_id", "turn", "text", tx.clean_complex(F.replace(ascii_text, F.lit("."), F.lit("/"))).alias("chains"))
    chains = F.col("chains")
    return turns.select(
        "conv_id", "turn", F.md5(chains).alias("digest"), tx.complex_mode(chains).alias("mode"),
        tx.complex_length(chains).cast("long").alias("length"), tx.job_name(F.col("text")).alias("job"), tx.job_id(chains).alias("job_id"))


@query("row_norm", """
  WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS place, unnest(embedding)::DOUBLE AS v FROM embeddings),
  m AS (SELECT vec_id, avg(v) AS m, var_pop(v) AS s FROM e GROUP BY vec_id)
  SELECT vec_id, CAST(place AS INTEGER) AS place, round((v - m) / sqrt(s + 1e-5), 5) + 0.0 AS value FROM e JOIN m USING (vec_id)
""")
def row_norm_query(spark, folder):
    normed = table(spark, folder, "embeddings").select("vec_id", F.posexplode(vec.row_norm(F.col("embedding"))).alias("place", "v"))
    return normed.select("vec_id", "place", (F.round("v", 5) + F.lit(0.0)).alias("value"))

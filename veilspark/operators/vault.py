"""The token store: keyed tables in Parquet, joined instead of looked up.

Tables: ``vault`` (pii_hash, token, encrypted_pii, created_at), ``entities``
(id, entity_type, canonical_name, created_at) and ``variants`` (variant_name,
canonical_id, created_at). A store is a folder; each change writes a new
version of a table and then moves the pointer to it, so readers see whole
versions and a failed job leaves the old one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ranges
from ..functions import spans
from ..functions.dialect import java
from ..functions.tokens import Keys, decrypt, encrypt

VAULT = "pii_hash string, token string, encrypted_pii string, created_at timestamp"
ENTITIES = "id string, entity_type string, canonical_name string, created_at timestamp"
VARIANTS = "variant_name string, canonical_id string, created_at timestamp"

# ------------------------------------------------------------ on DataFrames


def new_rows(vault: DataFrame, hits: DataFrame) -> DataFrame:
    """Insert or ignore: of ``hits`` (pii_hash, token, value[, ord]) the first per hash that the vault lacks."""
    order = ["ord", "token"] if "ord" in hits.columns else ["token"]
    first = hits.groupBy("pii_hash").agg(F.min_by(F.struct("token", "value"), F.struct(*order)).alias("f"))
    return first.join(vault.select("pii_hash"), "pii_hash", "left_anti").select("pii_hash", "f.token", "f.value")


def sealed(rows: DataFrame, keys: Keys, now: Column | None = None) -> DataFrame:
    """Rows of the vault's schema for (pii_hash, token, value)."""
    return rows.select("pii_hash", "token", encrypt(F.col("value"), keys).alias("encrypted_pii"), (now if now is not None else F.current_timestamp()).alias("created_at"))


def lookup(vault: DataFrame, hashes: DataFrame) -> DataFrame:
    """(pii_hash, token) for every hash, null where unknown."""
    return hashes.join(vault.select("pii_hash", "token"), "pii_hash", "left")


def purge(vault: DataFrame, cutoff: Column) -> DataFrame:
    """Rows that stay: strictly older ones than the cutoff go; rows without a time count as new."""
    return vault.where(F.coalesce(F.col("created_at") >= cutoff, F.lit(True)))


def erase(vault: DataFrame, tokens: DataFrame) -> DataFrame:
    return vault.join(tokens.select("token"), "token", "left_anti").select(*vault.columns)


def erased(vault: DataFrame, tokens: DataFrame) -> DataFrame:
    """DELETED or NOT_FOUND for each asked token."""
    known = vault.select("token", F.lit(True).alias("known")).distinct()
    return tokens.join(known, "token", "left").select("token", F.when(F.col("known"), "DELETED").otherwise("NOT_FOUND").alias("status"))


def reveal(tokens: DataFrame, vault: DataFrame, entities: DataFrame, keys: Keys) -> DataFrame:
    """(token, value) with entity names first, then decrypted values, then ERR_NOT_FOUND."""
    names = entities.select(F.concat(F.lit("["), "id", F.lit("]")).alias("token"), F.col("canonical_name").alias("name"))
    values = vault.select("token", decrypt(F.col("encrypted_pii"), keys).alias("plain")).dropDuplicates(["token"])
    return tokens.join(names, "token", "left").join(values, "token", "left").select("token", F.coalesce("name", "plain", F.lit("ERR_NOT_FOUND")).alias("value"))


def rehydrate(df: DataFrame, vault: DataFrame, keys: Keys, text: str = "text", key: str = "doc_id", out: str = "restored", passes: int = 2, entities: DataFrame | None = None) -> DataFrame:
    """Puts values back for tokens; unknown ones stay. Values may hold tokens themselves, hence two passes.

    Rows with one key, or none, share the values of all their tokens. Only rows with tokens meet the vault.
    """
    known = vault.select("token", decrypt(F.col("encrypted_pii"), keys).alias("plain"))
    if entities is not None:
        known = known.unionByName(entities.select(F.concat(F.lit("["), "id", F.lit("]")).alias("token"), F.col("canonical_name").alias("plain")))
    known = known.where("plain IS NOT NULL").groupBy("token").agg(F.min("plain").alias("plain"))
    df = df.withColumn(out, F.col(text))
    for _ in range(passes):
        marked = df.select(F.col(key).alias("_k"), F.explode(F.array_distinct(F.regexp_extract_all(out, F.lit(java(spans.TOKEN)), F.lit(0)))).alias("token")).distinct()
        maps = marked.join(known, "token").groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("token", "plain"))).alias("_m"))
        t, m = F.col(out), F.col("_m")
        put = spans.splice(t, spans.tokens(t), lambda s: F.coalesce(F.try_element_at(F.col("_m"), s["value"]), s["value"]))
        df = df.join(maps, df[key].eqNullSafe(maps["_k"]), "left").withColumn(out, F.when(m.isNull(), t).otherwise(put)).drop("_m", "_k")
    return df


def stats(vault: DataFrame) -> DataFrame:
    n = vault.agg(F.count("*").alias("entries"))
    return n.withColumn("approx_bytes", F.col("entries") * 256)


# ----------------------------------------------------------------- registry


def register(entities: DataFrame, variants: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New entities and new variants for ``seeds`` (ord, entity_type, canonical_name, variants).

    Types are upper case and trimmed; a name known in any case keeps its entity; numbers run on per type without
    gaps; a variant belongs to whoever had it first. Seeds without type or name are skipped.
    """
    given = seeds.select("ord", F.upper(F.btrim("entity_type")).alias("entity_type"), F.btrim("canonical_name").alias("canonical_name"), "variants").where("entity_type <> '' AND canonical_name <> ''").withColumn("low", F.lower("canonical_name"))
    first = given.groupBy("low").agg(F.min_by(F.struct("ord", "entity_type", "canonical_name"), "ord").alias("f")).select("low", "f.*")
    have = entities.withColumn("low", F.lower("canonical_name"))
    fresh = first.join(have.select("low"), "low", "left_anti")
    last = have.groupBy("entity_type").agg(F.max(F.regexp_extract("id", r"_([0-9]+)$", 1).cast("long")).alias("last"))
    # one type may hold nearly all entities: they are numbered by ranges
    dealt = ranges.carried(ranges.ranged(fresh, "entity_type", "ord", "low"), F.count("*"), F.sum, ("entity_type",))
    number = F.row_number().over(Window.partitionBy("entity_type", "_part").orderBy("ord", "low")) + F.coalesce("_carried", F.lit(0))
    made = dealt.withColumn("n", number).join(last, "entity_type", "left").select(
        F.concat_ws("_", "entity_type", (F.col("n") + F.coalesce("last", F.lit(0))).cast("string")).alias("id"), "entity_type", "canonical_name", F.current_timestamp().alias("created_at")
    )
    ids = have.select("low", "id").unionByName(made.select(F.lower("canonical_name").alias("low"), "id")).groupBy("low").agg(F.min("id").alias("id"))
    asked = given.join(ids, "low").select("ord", "id", F.posexplode("variants").alias("place", "v")).withColumn("variant_name", F.btrim("v")).where("variant_name <> ''")
    owner = asked.groupBy("variant_name").agg(F.min_by("id", F.struct("ord", "place")).alias("canonical_id"))
    new = owner.join(variants.select("variant_name"), "variant_name", "left_anti").withColumn("created_at", F.current_timestamp())
    return made, new.select("variant_name", "canonical_id", "created_at")


def listed(entities: DataFrame, variants: DataFrame) -> DataFrame:
    """Entities with their variants in order."""
    v = variants.groupBy(F.col("canonical_id").alias("id")).agg(F.array_sort(F.collect_list("variant_name")).alias("variants"))
    return entities.join(v, "id", "left").select("id", "entity_type", "canonical_name", F.coalesce("variants", F.array().cast("array<string>")).alias("variants"))


def resolve_names(names: DataFrame, entities: DataFrame, variants: DataFrame) -> DataFrame:
    """(name, token) by canonical name or variant in any case, two characters at least; null where unknown."""
    all_ = entities.select(F.lower("canonical_name").alias("low"), "id", F.lit(0).alias("o")).unionByName(variants.select(F.lower("variant_name").alias("low"), F.col("canonical_id").alias("id"), F.lit(1).alias("o")))
    one = all_.groupBy("low").agg(F.min_by("id", F.struct("o", "id")).alias("id"))
    return names.withColumn("low", F.when(F.char_length(F.btrim("name")) >= 2, F.lower(F.btrim("name")))).join(one, "low", "left").select("name", F.concat(F.lit("["), "id", F.lit("]")).alias("token"))


# -------------------------------------------------------------------- store


class Store:
    """A folder of versioned tables. One writer at a time. Readers need no lock; erasing and sweeping remove older versions,
    so a reader of one of these must read again."""

    SCHEMAS = {"vault": VAULT, "entities": ENTITIES, "variants": VARIANTS}

    def __init__(self, spark: SparkSession, root: str, keys: Keys):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), keys

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _versions(self, table: str) -> list[int]:
        fs, path = self._fs()
        base = path(f"{self.root}/{table}")
        if not fs.exists(base):
            return []
        done = [p.getPath() for p in fs.listStatus(base)]
        return sorted(int(p.getName()) for p in done if fs.exists(path(p, "_SUCCESS")))

    def read(self, table: str) -> DataFrame:
        found = self._versions(table)
        if not found:
            return self.spark.createDataFrame([], self.SCHEMAS[table])
        df = self.spark.read.schema(self.SCHEMAS[table]).parquet(f"{self.root}/{table}/{found[-1]}")
        return df.withColumn("created_at", F.coalesce("created_at", F.current_timestamp()))

    def write(self, table: str, df: DataFrame) -> None:
        found = self._versions(table)
        df.select(*[f.split()[0] for f in self.SCHEMAS[table].split(", ")]).write.parquet(f"{self.root}/{table}/{found[-1] + 1 if found else 0}")

    def _keep_last(self, table: str) -> None:
        """Removes all versions but the last: what was erased must not stay on disk."""
        fs, path = self._fs()
        last = self._versions(table)[-1]
        for p in fs.listStatus(path(f"{self.root}/{table}")):
            if p.getPath().getName() != str(last):
                fs.delete(p.getPath(), True)

    def add_hits(self, hits: DataFrame) -> None:
        """Stores (pii_hash, token, value) rows that are new."""
        vault = self.read("vault")
        self.write("vault", vault.unionByName(sealed(new_rows(vault, hits), self.keys)))

    def seed(self, seeds: DataFrame) -> None:
        entities, variants = self.read("entities"), self.read("variants")
        made, new = register(entities, variants, seeds)
        self.write("entities", entities.unionByName(made))
        # the second step reads the entities just written, so numbers agree
        self.write("variants", variants.unionByName(register(entities, variants, seeds)[1]))

    def sweep(self, days: int) -> int:
        vault = self.read("vault")
        cutoff = F.current_timestamp() - F.make_dt_interval(F.lit(days))
        gone = vault.count() - purge(vault, cutoff).count()
        if gone:
            self.write("vault", purge(vault, cutoff))
            self._keep_last("vault")
        return gone

    def forget(self, tokens: DataFrame) -> DataFrame:
        """Erases tokens, in older versions as well; the answers are a table of their own beside the versions."""
        vault = self.read("vault")
        answers = f"{self.root}/erased/{uuid.uuid4().hex}"
        erased(vault, tokens).write.parquet(answers)
        self.write("vault", erase(vault, tokens))
        self._keep_last("vault")
        return self.spark.read.parquet(answers)

    def migrate(self, other: Store) -> None:
        """Copies rows that the other store lacks; their time starts anew."""
        own, there = self.read("vault"), other.read("vault")
        moved = own.join(there.select("pii_hash"), "pii_hash", "left_anti").withColumn("created_at", F.current_timestamp())
        other.write("vault", there.unionByName(moved.select(*there.columns)))

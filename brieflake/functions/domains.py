"""Registrable domains by public-suffix rules: a table of rules, joined by label suffix.

Rules are the public list's: a plain suffix, a wildcard ("*.ck": any one label
more) and an exception ("!www.ck": one label less); the longest wins, an exception
wins over all.  A host under no rule has no registrable domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import urls

#: The public list as Spark's own HTTP client carries it on the class path.
ON_CLASS_PATH = "mozilla/public-suffix-list.txt"
#: The list is a fixed public table of some 10,000 rules; what is larger than this is none.
MOST_BYTES = 4 << 20
RULES = "suffix string, kind string"


def parsed_rules(text: str, private: bool = False) -> list[tuple[str, str]]:
    """(suffix, kind: plain, wildcard, exception) of a list in the public format; those of private domains only if asked for.  Names in other scripts count in both their forms."""
    out, inside = {}, True
    for line in text.splitlines():
        if "===BEGIN PRIVATE DOMAINS===" in line:
            inside = private
        name = line.split()[0].lower() if line.split() else ""
        if not name or name.startswith("//") or not inside:
            continue
        kind = "exception" if name[0] == "!" else "wildcard" if name.startswith("*.") else "plain"
        name = name.lstrip("!").removeprefix("*.")
        out[name, kind] = None
        try:
            out[name.encode("idna").decode(), kind] = None
        except UnicodeError:
            pass
    return sorted(out)


def suffix_rules(spark: SparkSession, path: str | None = None, private: bool = False) -> DataFrame:
    """(suffix, kind) from a list at ``path``, or from the one on Spark's class path."""
    if path is not None:
        size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
        if size > MOST_BYTES:
            raise ValueError(f"{path}: {size} bytes are no list of public suffixes")
        text = "\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())
    else:
        stream = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader().getResourceAsStream(ON_CLASS_PATH)
        if stream is None:
            raise ValueError(f"no {ON_CLASS_PATH} on the class path: name a list")
        text = spark._jvm.java.util.Scanner(stream, "UTF-8").useDelimiter("\\A").next()
    return spark.createDataFrame(parsed_rules(text, private), RULES)


def _normal(host: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(host), "。．｡", "..."), r"\.+$", "")


def domains(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, suffix, domain, name) of each distinct host: its public suffix and registrable domain, empty where there is none, and what stands for it among publishers: the domain, the last label of a host under no rule, an address as it is, nothing for a bare suffix."""
    h = hosts.select("host").where("host is not null").distinct().withColumn("labels", F.split(_normal(F.col("host")), r"\.")).withColumn("n", F.size("labels"))
    tail = lambda k: F.array_join(F.slice("labels", F.col("n") - k + 1, k), ".")
    cut = h.where(~urls.is_address(F.col("host"))).select("host", "n", F.explode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: F.struct(k.alias("k"), tail(k).alias("suffix")))).alias("x")).select("host", "n", "x.k", "x.suffix")
    # a fixed public table, bounded when it is read
    met = cut.join(F.broadcast(rules), "suffix").withColumn("length", F.col("k") + F.when(F.col("kind") == "wildcard", 1).when(F.col("kind") == "exception", -1).otherwise(0)).where("length <= n")
    best = met.groupBy("host").agg(F.max(F.when(F.col("kind") == "exception", F.col("length"))).alias("except"), F.max(F.when(F.col("kind") != "exception", F.col("length"))).alias("most"))
    j = h.join(best.select("host", F.coalesce("except", "most").alias("length")), "host", "left").withColumn("length", F.coalesce("length", F.lit(0)))
    domain = F.when((F.col("length") > 0) & (F.col("n") > F.col("length")), tail(F.col("length") + 1)).otherwise("")
    name = F.when(domain != "", domain).when(urls.is_address(F.col("host")), F.col("host")).when(F.col("length") > 0, "").otherwise(F.element_at("labels", -1))
    return j.select("host", F.when(F.col("length") > 0, tail(F.col("length"))).otherwise("").alias("suffix"), domain.alias("domain"), name.alias("name"))


def with_domains(df: DataFrame, hosts: Column, rules: DataFrame, out: str) -> DataFrame:
    """df with a map from each of a row's hosts (an array) to its domain and name.  Sets of hosts are the key, so rows need no id, and each set is looked up once."""
    keyed = df.withColumn("_hosts", F.array_sort(F.array_distinct(F.coalesce(hosts, F.array().cast("array<string>")))))
    sets = keyed.select("_hosts").distinct()
    each = sets.select("_hosts", F.explode("_hosts").alias("host"))
    known = each.join(domains(each, rules), "host").groupBy("_hosts").agg(F.map_from_entries(F.collect_list(F.struct("host", F.struct("domain", "name")))).alias(out))
    none = F.expr("cast(map() as map<string,struct<domain:string,name:string>>)")
    return keyed.join(known, "_hosts", "left").withColumn(out, F.coalesce(out, none)).drop("_hosts")

"""URL filters: a blocked Bloom filter of listed canonical URLs, and an exact hash join of its possible hits.

A list has entries of a host, a path and a verdict. A rule ('prefix') fits a URL of its host or any subdomain whose path
starts with the rule's; an address ('exact') fits URLs whose canonical form has its host and path. The longest rule that
fits decides (of equally long ones the longest host, then the smallest text, then block before allow). Where no rule
fits, a listed address decides (block before allow), and else the verdict is the default.

Canonical form: A-Z of the host in lower case, no scheme, user, default port, query or fragment, no full stop at the
host's end and no slash at the path's end.

Every entry is a key of kind, host and path. A URL could meet as many keys as the list has shapes (labels of the host,
characters of the path), plus one for its canonical form; shapes are few, as there is one for each different size only.
The Bloom filter is an array of blocks of 64 bits: a key's hash picks a block and HASHES bits of it. It is built by
bit_or over the list and grows with it up to MAX_BLOCKS (16 MB), so it always fits beside the plan; a fuller filter
costs time and changes nothing. URLs with no possible hit never leave the task that reads them. The others' hosts and
paths are made distinct and meet the list by key; what they met goes back to their rows. Both joins are salted, so an
entry or a URL that a third of all rows have is dealt over SALTS tasks.

Only DataFrame functions are used. Cases: a null URL or one without :// has an empty host and path, meets no entry and
has the default verdict; an empty path meets no rule whose path is not empty; entries without host are an error; an
empty list leaves every URL to the default; repeated rows each come back; an empty table gives none; columns of pages
pass through, and those named host, path, rule or verdict keep their names, the operator's then get an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, written

HASHES = 6
SALTS = 16
BITS_A_KEY = 16
#: Blocks of 64 bits: 16 MB.
MAX_BLOCKS = 1 << 21
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LISTED_DDL = "host string, path string, verdict string, kind string"


def host_of(url: str | Column) -> Column:
    u = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    return F.translate(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: str | Column) -> Column:
    u = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    return F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical_host(host: Column) -> Column:
    """A host without user, default port and closing full stop."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(:(80|443))?$", "")


def canonical_path(path: Column) -> Column:
    return F.regexp_replace(path, "/+$", "")


def listed_keys(listed: DataFrame) -> DataFrame:
    """kind, host, path, verdict and key of each entry, once."""
    host, path = F.translate(F.trim("host"), _UPPER, _LOWER), F.coalesce("path", F.lit(""))
    exact = F.col("kind") == "exact"
    named = listed.select("kind", F.when(exact, canonical_host(host)).otherwise(host).alias("host"), F.when(exact, canonical_path(path)).otherwise(path).alias("path"), "verdict")
    checked = F.when((F.coalesce("host", F.lit("")) == "") | ~F.col("kind").isin("prefix", "exact") | ~F.col("verdict").isin("allow", "block"), F.raise_error(F.lit("a listed URL needs a host, a kind (prefix or exact) and a verdict (allow or block)"))).otherwise(F.col("host"))
    keyed = named.withColumn("host", checked).withColumn("key", key_of(F.col("kind"), F.col("host"), F.col("path")))
    return keyed.groupBy("key", "kind", "host", "path").agg(F.max("verdict").alias("verdict"))  # block comes after allow


def key_of(kind: Column, host: Column, path: Column) -> Column:
    # a host has no slash, so host and path are told apart
    return F.concat(kind, F.lit(":"), host, F.lit("/"), path)


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def _mask(key: Column) -> Column:
    """The HASHES bits of a key in its block: six bits each of a second hash."""
    h, out = F.xxhash64(F.lit(7), key), F.lit(0).cast("long")
    for i in range(HASHES):
        place = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return out


class Bloom:
    """A filter over keys of a list: may_have(key) is true for all of them and for few others."""

    def __init__(self, keys: DataFrame, n_keys: int, bits_a_key: int = BITS_A_KEY, most: int = MAX_BLOCKS):
        self.n_blocks = min(most, max(1, -(-n_keys * bits_a_key // 64)))
        bits = keys.groupBy(_block(F.col("key"), self.n_blocks).alias("id")).agg(F.bit_or(_mask(F.col("key"))).alias("bits"))
        every = keys.sparkSession.range(self.n_blocks).join(bits, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
        # one array of n_blocks values
        self.blocks = written(every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x.bits).alias("blocks")), "bloom").scalar()

    def may_have(self, key: Column) -> Column:
        mask = _mask(key)
        return F.get(self.blocks, _block(key, self.n_blocks).cast("int")).bitwiseAND(mask) == mask


def _shapes(keys: DataFrame) -> list[tuple[int, int]]:
    """The different (labels of the host, characters of the path) of the rules: few, whatever the length of the list."""
    rows = keys.filter("kind = 'prefix'").select(F.size(F.split("host", r"\.")).alias("labels"), F.char_length("path").alias("chars")).distinct().orderBy("labels", "chars").collect()
    return [(r["labels"], r["chars"]) for r in rows]


def _candidates(host: Column, path: Column, shapes: list[tuple[int, int]], bloom: Bloom) -> Column:
    """The keys that a URL could meet and that may be listed."""
    labels = F.size(F.split(host, r"\."))
    keys = [F.when((labels >= n) & (F.char_length(path) >= c), key_of(F.lit("prefix"), F.substring_index(host, ".", -n), F.substring(path, 1, c))) for n, c in shapes]
    keys.append(key_of(F.lit("exact"), canonical_host(host), canonical_path(path)))
    return F.array_compact(F.array(*[F.when((host != "") & bloom.may_have(k), k) for k in keys]))


def _salted(df: DataFrame, salt: str) -> DataFrame:
    return df.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))


def _salt() -> Column:
    """Deals rows over SALTS tasks; which one a row meets changes nothing, as the other side is in all of them."""
    return F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))


def judged(pages: DataFrame, listed: DataFrame, url: str = "url", *, default: str = "allow") -> DataFrame:
    """pages with host, path, rule (host and path of the rule that decided), listed_url (of the address that did) and verdict.

    listed: host, path, verdict (allow or block), kind (prefix or exact).
    """
    keys = written(listed_keys(listed), "listed")
    bloom, shapes = Bloom(keys, keys.count()), _shapes(keys)
    host, path, rule, address, verdict = (free_name(c, pages) for c in ("host", "path", "rule", "listed_url", "verdict"))
    hits, salt, found, at_host, at_path = (free_name(c, pages) for c in ("_hits", "_salt", "_found", "_host", "_path"))
    told = pages.withColumns({host: host_of(url), path: path_of(url)})
    told = told.withColumn(hits, _candidates(F.col(host), F.col(path), shapes, bloom))
    columns = [*pages.columns, host, path]
    passed = told.filter(F.size(hits) == 0).select(*columns, F.lit(None).cast("string").alias(rule), F.lit(None).cast("string").alias(address), F.lit(default).alias(verdict))

    possible = told.filter(F.size(hits) > 0)
    entry = F.struct((F.col("kind") == "prefix").alias("is_rule"), F.char_length(F.concat("host", "path")).alias("size"), F.char_length("host").alias("host_size"), (F.col("verdict") == "block").alias("blocks"), "host", "path")
    right = _salted(keys.select("key", entry.alias("entry")), "salt")
    met = possible.select(F.col(host).alias(at_host), F.col(path).alias(at_path), hits).dropDuplicates([at_host, at_path]).select(at_host, at_path, F.explode(hits).alias("key")).withColumn("salt", _salt())
    # the greatest entry is a rule before an address, then the longest
    decided = met.join(right, ["key", "salt"]).groupBy(at_host, at_path).agg(F.max("entry").alias(found))

    out = possible.withColumn(salt, _salt()).join(_salted(decided, salt).withColumnsRenamed({at_host: host, at_path: path}), [host, path, salt], "left")
    text, is_rule = F.concat(F.col(f"{found}.host"), F.col(f"{found}.path")), F.coalesce(F.col(f"{found}.is_rule"), F.lit(False))
    said = F.when(F.col(found).isNull(), F.lit(default)).when(F.col(f"{found}.blocks"), "block").otherwise("allow")
    return passed.unionByName(out.select(*columns, F.when(is_rule, text).alias(rule), F.when(~is_rule, text).alias(address), said.alias(verdict)))

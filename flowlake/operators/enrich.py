"""From wire documents to fact rows, messages and address forms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _wrappings(meta: str) -> Column:
    item = lambda w: F.struct(
        w["index"].alias("index"),
        w["unwrapped_chain"]["universal_chain_id"].alias("unwrapped_chain"),
        w["unwrapped_address_hex"].alias("unwrapped_address"),
        w["wrapped_chain"]["universal_chain_id"].alias("wrapped_chain"),
    )
    return F.transform(F.col(f"{meta}.wrapping"), item)


def to_transfer_model(raw: DataFrame) -> DataFrame:
    """PRJ1-2: raw documents as flat columns with both wrapping arrays, where they were read; the canonical symbol is the base symbol."""
    chain = ["universal_chain_id", "chain_id", "display_name", "testnet", "rpc_type", "addr_prefix"]
    wrappings = [_wrappings(f"{t}_token_meta").alias(f"{t}_wrapping") for t in ("quote", "base") if f"{t}_token_meta" in raw.columns]
    ends = [F.col(f"{d}_chain.{c}").alias(f"{s}_{c}") for s, d in (("source", "source"), ("dest", "destination")) for c in chain]
    return raw.select(
        "packet_hash", "sort_order", *ends,
        "sender_canonical", "sender_display", "receiver_canonical", "receiver_display",
        F.try_to_timestamp("transfer_send_timestamp").alias("timestamp"),
        F.col("transfer_send_transaction_hash").alias("tx_hash"),
        "base_token", "base_amount", F.col("base_token_symbol").alias("token_symbol"),
        F.col("base_token_symbol").alias("canonical_token_symbol"), "base_token_decimals", "wrap_direction",
        *wrappings,
    )


def scale_amount(df: DataFrame, amount: str = "base_amount", decimals: str = "base_token_decimals") -> DataFrame:
    """PRJ4: ``amount`` in display units, exact to 18 places; blank, zero or unparsable amounts are 0.

    Whole numbers that do not fit the decimal type give null with ``amount_overflow`` set, not 0.
    """
    text = F.trim(F.coalesce(F.col(amount), F.lit("")))
    places = F.greatest(F.coalesce(F.col(decimals), F.lit(0)), F.lit(0))
    number = text.rlike("^[+-]?[0-9]+$")
    # the decimal point is moved by an exponent of the text, so nothing is rounded before the 18th place
    scaled = F.concat(text, F.lit("E-"), places.cast("string")).try_cast("decimal(38,18)")
    value = F.when(number, scaled).otherwise(F.lit(0).cast("decimal(38,18)"))
    return df.withColumn("amount", value).withColumn("amount_overflow", number & scaled.isNull())


def enrich_transfers(df: DataFrame) -> DataFrame:
    """PRJ5: transaction hash fallback, testnet flag, formatted time, route key and display names."""
    return df.withColumns(
        {
            "tx_hash": F.coalesce(F.nullif(F.col("tx_hash"), F.lit("")), "packet_hash"),
            "is_testnet_transfer": F.coalesce("source_testnet", F.lit(False)) | F.coalesce("dest_testnet", F.lit(False)),
            "formatted_timestamp": F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"),
            "route_key": F.concat_ws("_", "source_universal_chain_id", "dest_universal_chain_id"),
            "source_display_name": F.col("source_display_name"),
            "dest_display_name": F.col("dest_display_name"),
        }
    )


def to_broadcast(df: DataFrame) -> DataFrame:
    """PRJ6: the message row; a missing display address is the canonical one."""
    chain = ["universal_chain_id", "display_name", "chain_id", "testnet", "rpc_type", "addr_prefix"]
    end = lambda s: F.struct(*[F.col(f"{s}_{c}").alias(c) for c in chain])
    shown = lambda s: F.coalesce(F.nullif(F.col(f"{s}_display"), F.lit("")), f"{s}_canonical")
    return df.select(
        end("source").alias("source_chain"), end("dest").alias("destination_chain"), "packet_hash",
        F.col("is_testnet_transfer").alias("isTestnetTransfer"),
        F.col("source_display_name").alias("sourceDisplayName"), F.col("dest_display_name").alias("destinationDisplayName"),
        F.col("formatted_timestamp").alias("formattedTimestamp"), F.col("route_key").alias("routeKey"),
        shown("sender").alias("senderDisplay"), shown("receiver").alias("receiverDisplay"),
    )


def to_fact_rows(df: DataFrame) -> DataFrame:
    """SNK2: the columns of the transfers table; ``created_at`` is the send time."""
    return df.select(
        "packet_hash", "sort_order",
        F.col("source_universal_chain_id").alias("source_chain"), F.col("dest_universal_chain_id").alias("dest_chain"),
        F.col("source_display_name").alias("source_name"), F.col("dest_display_name").alias("dest_name"),
        F.col("sender_canonical").alias("sender"), F.col("receiver_canonical").alias("receiver"),
        "amount", "token_symbol", "canonical_token_symbol", "timestamp", F.col("timestamp").alias("created_at"),
    )


def filter_chains(t: DataFrame, from_: str | None = None, to: str | None = None) -> DataFrame:
    """PRJ11: both chosen: that direction only; one chosen: that chain at either end."""
    source, dest = F.col("source_chain"), F.col("dest_chain")
    if from_ and to:
        return t.filter((source == from_) & (dest == to))
    if from_ or to:
        return t.filter((source == (from_ or to)) | (dest == (from_ or to)))
    return t


def filter_network(t: DataFrame, networks: list[str]) -> DataFrame:
    """SRC7: transfers with a listed chain at either end."""
    return t.filter(F.col("source_chain").isin(networks) | F.col("dest_chain").isin(networks))


def with_chain_names(t: DataFrame, chains: DataFrame) -> DataFrame:
    """JN7: names of both ends: display name, else chain id, else the raw id. Spark broadcasts the dimension if its size allows."""
    name = F.coalesce(F.nullif("display_name", F.lit("")), F.nullif("chain_id", F.lit("")), "universal_chain_id")
    named = chains.select(F.col("universal_chain_id").alias("__id"), name.alias("__name")).dropDuplicates(["__id"])
    for side in ("source", "dest"):
        joined = t.join(named, F.col(f"{side}_chain") == F.col("__id"), "left")
        t = joined.withColumn(f"{side}_label", F.coalesce("__name", f"{side}_chain")).drop("__id", "__name")
    return t


#: The bech32 alphabet and checksum generators.
BECH32_ALPHABET = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_GENERATORS = [0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3]


def _checksum(values: list[int]) -> int:
    state = 1
    for v in values:
        top, state = state >> 25, ((state & 0x1FFFFFF) << 5) ^ v
        for i, g in enumerate(BECH32_GENERATORS):
            state ^= g if top >> i & 1 else 0
    return state


def bech32(prefix: str, data: bytes) -> str:
    """Bech32 text of ``data`` under a human-readable prefix."""
    bits = "".join(f"{b:08b}" for b in data)
    bits += "0" * (-len(bits) % 5)
    groups = [int(bits[i : i + 5], 2) for i in range(0, len(bits), 5)]
    head = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix]
    state = _checksum(head + groups + [0] * 6) ^ 1
    groups += [state >> 5 * (5 - i) & 31 for i in range(6)]
    return f"{prefix}1" + "".join(BECH32_ALPHABET[g] for g in groups)


@F.pandas_udf(T.StringType())
def _to_bech32(digits: pd.Series, prefix: pd.Series) -> pd.Series:
    """Hex digits -> bech32 of their first 20 bytes."""
    return pd.Series([None if h is None or p is None else bech32(p, bytes.fromhex(h)[:20]) for h, p in zip(digits, prefix)], dtype="object")


def format_address(address: Column, rpc_type: Column, prefix: Column) -> Column:
    """PRJ13: the address in the form of its chain type."""
    kind, clean = F.lower(F.trim(rpc_type)), F.trim(address)
    bare = F.regexp_replace(clean, "^0x", "")
    is_hex = bare.rlike("^[0-9a-fA-F]*$")
    bech32_like = clean.rlike("^[^1]{3,10}1[^1]{30,}$")
    done = clean.startswith(F.concat(prefix, F.lit("1"))) & (F.length(clean) > 39)
    convertible = is_hex & (F.length(bare) >= 32) & (F.length(bare) % 2 == 0)
    cosmos = F.when(F.coalesce(prefix, F.lit("")) == "", address).when(done | bech32_like, clean).otherwise(
        F.coalesce(_to_bech32(F.when(kind.isin("cosmos", "cosmos-sdk") & convertible, bare), prefix), address))
    padded = F.lpad(bare, F.greatest(F.length(bare), F.lit(40)), F.lit("0"))
    pairs = is_hex & (F.length(bare) % 2 == 0)
    # an address of the right form may look like bech32 by chance: forms come first
    evm = F.when(clean.startswith("0x") & (F.length(clean) == 42), F.lower(clean)).when(
        pairs & ((F.length(clean) == 40) | ~bech32_like), F.lower(F.concat(F.lit("0x"), padded))).otherwise(address)
    return F.when(F.coalesce(address, F.lit("")) == "", F.lit("")).when(kind.isin("cosmos", "cosmos-sdk"), cosmos).when(
        kind.isin("evm", "ethereum"), evm).otherwise(address)


def build_address_dim(t: DataFrame, chains: DataFrame) -> DataFrame:
    """PRJ13: distinct (address, chain) of both ends with the formatted address.

    Addresses are formatted once each, after the distinct, not once per transfer.
    """
    end = lambda a, c: F.struct(F.col(a).alias("address"), F.col(c).alias("universal_chain_id"))
    ends = t.select(F.explode(F.array(end("sender", "source_chain"), end("receiver", "dest_chain"))).alias("x")).select("x.*").distinct()
    forms = chains.select("universal_chain_id", "rpc_type", "addr_prefix").dropDuplicates(["universal_chain_id"])
    joined = ends.join(forms, "universal_chain_id", "left")
    return joined.select("address", "universal_chain_id", format_address(F.col("address"), F.col("rpc_type"), F.col("addr_prefix")).alias("formatted"))

"""Column encryption with keys looked up by key id."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Key derivation.
ROUNDS = 100_000
KEY_BYTES = 32


def derive_key(password: str, salt: bytes) -> bytes:
    """Key from a password; done once per key, never per row."""
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, ROUNDS, KEY_BYTES)


def key_table(spark: SparkSession, keys: dict[str, bytes]) -> DataFrame:
    """The key ring as a table (a handful of rows), so no key is a literal in a plan."""
    return spark.createDataFrame(
        [(k, bytearray(v)) for k, v in keys.items()], "key_id string, _key binary"
    )


def fingerprints(keys: DataFrame) -> DataFrame:
    """Recognisable, non-secret marks of the keys."""
    return keys.select("key_id", F.substring(F.sha2("_key", 256), 1, 16).alias("fingerprint"))


def _with_key(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Look the key of each row up; a row without a known key stops the job.

    The key ring is made on the driver (see :func:`key_table`), so it is small
    enough to broadcast.
    """
    joined = df.join(F.broadcast(keys), "key_id", "left")
    missing = F.raise_error(F.concat(F.lit("no key with id "), F.coalesce("key_id", F.lit("null"))))
    return joined.withColumn("_key", F.when(F.col("_key").isNull(), missing).otherwise(F.col("_key")))


def encrypt_columns(df: DataFrame, columns: Sequence[str], keys: DataFrame) -> DataFrame:
    """AES-GCM ciphertext per column: nonce, ciphertext, tag. ``df`` has a ``key_id``.

    Each call draws fresh nonces; store the result before using it twice.
    """
    sealed = {c: F.aes_encrypt(F.col(c).cast("binary"), F.col("_key"), F.lit("GCM")) for c in columns}
    return _with_key(df, keys).withColumns(sealed).drop("_key")


def decrypt_columns(df: DataFrame, columns: Sequence[str], keys: DataFrame) -> DataFrame:
    opened = {c: F.aes_decrypt(F.col(c), F.col("_key"), F.lit("GCM")) for c in columns}
    return _with_key(df, keys).withColumns(opened).drop("_key")


def rotate_keys(
    df: DataFrame, columns: Sequence[str], keys: DataFrame, new_key_id: Column
) -> DataFrame:
    """Re-encrypt under other keys of the ring, row by row and without a shuffle."""
    plain = decrypt_columns(df, columns, keys)
    return encrypt_columns(plain.withColumn("key_id", new_key_id), columns, keys)

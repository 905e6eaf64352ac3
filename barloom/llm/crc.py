"""DuckDB SQL for CRC-32, which it has no function for.

The checksum is linear over XOR: that of a text is the XOR of what each byte adds, by its distance from the end, and of
what the length adds. Both are small recursive tables."""

#: Bytes of a text at most.
CRC_BYTES = 2000

#: Common tables crc_zero(k, c): of k bytes of zero; crc_far(k, b, c): what byte b before k others adds.
CRC_TABLES = f"""
crc_bits AS (SELECT b, 0 AS k, b AS c FROM range(256) t(b)
    UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_bits WHERE k < 8),
crc_byte AS (SELECT b, c FROM crc_bits WHERE k = 8),
crc_far AS (SELECT 0 AS k, b, c FROM crc_byte
    UNION ALL SELECT k + 1, f.b, xor(f.c >> 8, t.c) FROM crc_far f JOIN crc_byte t ON t.b = f.c & 255 WHERE k < {CRC_BYTES}),
crc_zero AS (SELECT 0 AS k, 4294967295::BIGINT AS c
    UNION ALL SELECT k + 1, xor(f.c >> 8, t.c) FROM crc_zero f JOIN crc_byte t ON t.b = f.c & 255 WHERE k < {CRC_BYTES})"""


def crc_of(source: str) -> str:
    """A query that gives (x, h), h = crc32 of the UTF-8 bytes of x, for the texts x of the query source."""
    return f"""SELECT x, xor(xor(bit_xor(f.c), any_value(z.c)), 4294967295) AS h
    FROM (SELECT x, strlen(x) AS n, unnest(range(strlen(x))) AS i, hex(x) AS raw FROM ({source}) q) p
    JOIN crc_far f ON f.k = n - 1 - i AND f.b = ('0x' || substr(raw, 2 * i + 1, 2))::BIGINT JOIN crc_zero z ON z.k = n GROUP BY x"""

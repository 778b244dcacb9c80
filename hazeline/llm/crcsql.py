"""CRC-32 in DuckDB's SQL, for the oracles of operators that hash by it."""

#: Common table expression with the 256 steps of a byte, as the list crc_table.t.
TABLE = """crc_table AS (SELECT list(list_reduce([n]::UBIGINT[] || [0,0,0,0,0,0,0,0]::UBIGINT[], lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END) ORDER BY n) AS t
  FROM range(256) r(n))"""


def crc32(text: str) -> str:
    """SQL for the value of the text's UTF-8 bytes, where crc_table.t is in scope."""
    return f"""xor(list_reduce([4294967295]::UBIGINT[] || list_transform(range(1, octet_length(encode({text})) + 1), lambda k: ('0x' || substr(hex(encode({text})), 2 * k - 1, 2))::UBIGINT),
    lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)"""

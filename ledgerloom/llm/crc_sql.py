"""CRC-32 in SQL, for engines that have no such function."""

from __future__ import annotations

#: Common table expressions from f(f) (distinct texts) to crc(f, v), for a WITH RECURSIVE.  CRC-32 is linear: it is the
#: XOR of what each byte gives at its distance from the end, and of the first register moved over all bytes.
CRC = """
crc_text as (select f, hex(encode(f)) as x, octet_length(encode(f)) as n from f),
crc_bits as (select range as b, 0 as k, range::ubigint as v from range(256) union all
  select b, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384::ubigint) else v >> 1 end from crc_bits where k < 8),
crc_step as materialized (select b, v from crc_bits where k = 8),
crc_far as (select b, 0 as dist, v from crc_step union all
  select crc_far.b, crc_far.dist + 1, xor(crc_far.v >> 8, crc_step.v) from crc_far join crc_step on crc_step.b = crc_far.v & 255 where crc_far.dist < (select max(n) from crc_text)),
crc_head as (select 0 as n, 4294967295::ubigint as v union all
  select crc_head.n + 1, xor(crc_head.v >> 8, crc_step.v) from crc_head join crc_step on crc_step.b = crc_head.v & 255 where crc_head.n < (select max(n) from crc_text)),
crc_byte as (select f, n, unnest(range(n)) as i, x from crc_text),
crc as (select crc_byte.f, xor(xor(bit_xor(crc_far.v), any_value(crc_head.v)), 4294967295::ubigint) as v
  from crc_byte join crc_far on crc_far.dist = crc_byte.n - 1 - crc_byte.i and crc_far.b = ('0x' || substr(x, (2 * i + 1)::int, 2))::int join crc_head on crc_head.n = crc_byte.n group by crc_byte.f)"""

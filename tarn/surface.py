"""Registered queries over the rest of the scalar and aggregate functions, with their SQL for comparison."""

from __future__ import annotations

_X = "(l_quantity - 25.5) / 26"  # within -1 to 1


def _rounded(*calls: str) -> str:
    return ", ".join(f"round({c}, 9) AS v{i}" for i, c in enumerate(calls))


#: Statements that Spark and the oracle read alike.
COMMON = {
    "fn_trigonometry": "SELECT l_orderkey, l_linenumber, " + _rounded(f"acos({_X})", f"asin({_X})", f"atan({_X})", f"atan2({_X}, l_quantity)", f"cos({_X})", f"sin({_X})", f"tan({_X})", "cot(l_quantity)", f"degrees({_X})", "radians(l_quantity)") + " FROM lineitem",
    "fn_hyperbolic": "SELECT l_orderkey, l_linenumber, " + _rounded("acosh(l_quantity + 1)", f"asinh({_X})", f"atanh({_X} * 0.5)", f"cosh({_X})", f"sinh({_X})", f"tanh({_X})", "cbrt(l_quantity)") + " FROM lineitem",
    "fn_greatest": "SELECT p_partkey, greatest(p_size, 20) AS g, least(p_size, 20, p_partkey) AS l, coalesce(nullif(p_size, 7), -7) AS c FROM part",
    "fn_strings": "SELECT p_partkey, CAST(ascii(p_name) AS BIGINT) AS a, CAST(char_length(p_name) AS BIGINT) AS cl, chr(p_size + 64) AS ch, ltrim(concat('  ', p_name, ' ')) AS lt, rtrim(concat(' ', p_name, '  ')) AS rt, concat_ws('/', p_brand, p_type) AS cw, translate(p_name, 'aeiou', '12345') AS tr, CAST(position('a' IN p_name) AS BIGINT) AS po, CAST(levenshtein(p_name, p_brand) AS BIGINT) AS lv, right(p_type, 4) AS ri FROM part",
    "agg_regr_all": "SELECT l_returnflag, round(regr_sxx(l_extendedprice, l_quantity) / 1000000, 4) AS sxx, round(regr_syy(l_extendedprice, l_quantity) / 1000000000000, 4) AS syy, round(regr_sxy(l_extendedprice, l_quantity) / 1000000000, 4) AS sxy, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem GROUP BY l_returnflag",
}

#: Statements that differ in names only: (Spark's, the oracle's).
PAIRS = {
    "agg_array": ("SELECT n_regionkey, array_join(sort_array(array_agg(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(array_agg(n_name ORDER BY n_name), ',') AS names FROM nation GROUP BY n_regionkey"),
    "fn_numbers": (
        "SELECT p_partkey, CAST(factorial(p_size % 15) AS BIGINT) AS f, isnan(CAST('nan' AS DOUBLE)) AS nan1, isnan(p_retailprice) AS nan2, round(log(p_retailprice), 9) AS ln_, round(log(2, p_size), 9) AS lb, nanvl(CAST('nan' AS DOUBLE), p_retailprice) AS nv, round(pi(), 9) AS pi_, rand() BETWEEN 0 AND 1 AS rnd, p_size = 0 AS zero, shiftleft(p_size, 2) AS sl, pmod(-p_size, 7) AS pm FROM part",
        "SELECT p_partkey, CAST(factorial(CAST(p_size % 15 AS INTEGER)) AS BIGINT) AS f, isnan(CAST('nan' AS DOUBLE)) AS nan1, isnan(p_retailprice) AS nan2, round(ln(p_retailprice), 9) AS ln_, round(log2(p_size), 9) AS lb, p_retailprice AS nv, round(pi(), 9) AS pi_, random() BETWEEN 0 AND 1 AS rnd, p_size = 0 AS zero, p_size << 2 AS sl, ((-p_size % 7) + 7) % 7 AS pm FROM part",
    ),
    "fn_nulls": (
        "SELECT c_custkey, nvl(nullif(c_nationkey, 4), -1) AS nv, nvl2(nullif(c_mktsegment, 'BUILDING'), 'some', 'none') AS n2, ifnull(nullif(c_nationkey, 5), -5) AS i, if(c_acctbal < 0, 'debt', 'none') AS d FROM customer",
        "SELECT c_custkey, coalesce(nullif(c_nationkey, 4), -1) AS nv, CASE WHEN nullif(c_mktsegment, 'BUILDING') IS NULL THEN 'none' ELSE 'some' END AS n2, coalesce(nullif(c_nationkey, 5), -5) AS i, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'none' END AS d FROM customer",
    ),
    "fn_strings_named": (
        "SELECT p_partkey, CAST(bit_length(p_name) AS BIGINT) AS bl, CAST(octet_length(p_name) AS BIGINT) AS ol, btrim(concat('xx', p_name, 'x'), 'x') AS bt, initcap(concat(lower(p_brand), ' of ', lower(p_type))) AS ic, overlay(p_name PLACING '__' FROM 2 FOR 3) AS ov, CAST(find_in_set(CAST(p_size % 5 AS STRING), '3,1,4,2') AS BIGINT) AS fs, startswith(p_brand, 'Brand#1') AS sw, endswith(p_type, 'L') AS ew, substring_index(p_brand, '#', 1) AS si, length(uuid()) = 36 AS uu, lower(hex(p_partkey)) AS th, space(2) AS sp, CAST(locate('r', p_brand, 3) AS BIGINT) AS lo FROM part",
        "SELECT p_partkey, CAST(bit_length(p_name) AS BIGINT) AS bl, CAST(octet_length(encode(p_name)) AS BIGINT) AS ol, trim(concat('xx', p_name, 'x'), 'x') AS bt, array_to_string(list_transform(string_split(concat(lower(p_brand), ' of ', lower(p_type)), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS ic, left(p_name, 1) || '__' || substr(p_name, 5) AS ov, CAST(coalesce(list_position(['3', '1', '4', '2'], CAST(p_size % 5 AS VARCHAR)), 0) AS BIGINT) AS fs, starts_with(p_brand, 'Brand#1') AS sw, ends_with(p_type, 'L') AS ew, split_part(p_brand, '#', 1) AS si, length(CAST(uuid() AS VARCHAR)) = 36 AS uu, lower(printf('%x', p_partkey)) AS th, '  ' AS sp, CAST(CASE WHEN strpos(substr(p_brand, 3), 'r') = 0 THEN 0 ELSE strpos(substr(p_brand, 3), 'r') + 2 END AS BIGINT) AS lo FROM part",
    ),
    "fn_regexp_like": (
        "SELECT p_partkey, regexp_like(p_brand, '#[1-3]') AS rl, CAST(regexp_count(p_type, '[AEIOU]') AS BIGINT) AS rc, array_join(regexp_extract_all(p_brand, '[0-9]', 0), ',') AS ra, p_type RLIKE '(STEEL|BRASS)' AS similar FROM part",
        "SELECT p_partkey, regexp_matches(p_brand, '#[1-3]') AS rl, CAST(len(regexp_extract_all(p_type, '[AEIOU]')) AS BIGINT) AS rc, array_to_string(regexp_extract_all(p_brand, '[0-9]'), ',') AS ra, regexp_matches(p_type, '(STEEL|BRASS)') AS similar FROM part",
    ),
    "fn_dates_made": (
        "SELECT o_orderkey, CAST(make_date(year(o_orderdate), month(o_orderdate), 1) AS STRING) AS md, date_format(o_orderdate, 'yyyy/MM/dd') AS tc, CAST(to_date(date_format(o_orderdate, 'yyyy-MM-dd')) AS STRING) AS td, date_format(to_timestamp(date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss')), 'yyyyMMddHHmmss') AS tt, from_unixtime(unix_timestamp(o_orderdate)) AS fu, CAST(date_part('doy', o_orderdate) AS BIGINT) AS dp, CAST(dayofweek(o_orderdate) - 1 AS BIGINT) AS dw, CAST(weekofyear(o_orderdate) AS BIGINT) AS wk, current_date() >= DATE '2024-01-01' AS cd, now() >= TIMESTAMP '2024-01-01 00:00:00' AS nw, CAST(last_day(o_orderdate) AS STRING) AS ld, CAST(add_months(CAST(o_orderdate AS DATE), 1) AS STRING) AS am, unix_millis(timestamp_millis(o_orderkey * 1000)) AS tm, unix_micros(timestamp_micros(o_orderkey)) AS tu, unix_seconds(timestamp_seconds(o_orderkey)) AS ts FROM orders",
        "SELECT o_orderkey, CAST(make_date(year(o_orderdate), month(o_orderdate), 1) AS VARCHAR) AS md, strftime(o_orderdate, '%Y/%m/%d') AS tc, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS td, strftime(o_orderdate, '%Y%m%d%H%M%S') AS tt, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS fu, CAST(date_part('doy', o_orderdate) AS BIGINT) AS dp, CAST(date_part('dow', o_orderdate) AS BIGINT) AS dw, CAST(weekofyear(o_orderdate) AS BIGINT) AS wk, current_date >= DATE '2024-01-01' AS cd, now() >= TIMESTAMP '2024-01-01 00:00:00' AS nw, CAST(last_day(o_orderdate) AS VARCHAR) AS ld, CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS am, o_orderkey * 1000 AS tm, o_orderkey AS tu, o_orderkey AS ts FROM orders",
    ),
    "fn_arrays_made": (
        "SELECT p_partkey, array_join(array_append(array(p_size, 1), 2), ',') AS ap, array_join(array_prepend(array(p_size, 1), 2), ',') AS pr, array_join(array_remove(array(1, p_size, 3), 3), ',') AS re, array_join(array_repeat(p_size, 3), ',') AS rp, array_join(sort_array(array_except(array(1, 2, 3, 100), array(p_size, 1))), ',') AS ex, array_join(sort_array(array_intersect(array(1, 2, 3), array(p_size, 1))), ',') AS it, array_join(sort_array(array_union(array(1, 2), array(p_size, 1))), ',') AS un, CAST(array_position(array(5, p_size, 7), 7) AS BIGINT) AS po, CAST(cardinality(sequence(1, p_size)) AS BIGINT) AS ca, arrays_overlap(array(1, 2, p_size), array(30, 40)) AS ov, array_max(array(p_size, 25)) AS mx, array_join(split(p_brand, '#'), '|') AS sp, size(array_except(array(1, 2), array(p_size, 1))) = 0 AS al FROM part",
        "SELECT p_partkey, array_to_string(list_append([p_size, 1], 2), ',') AS ap, array_to_string(list_prepend(2, [p_size, 1]), ',') AS pr, array_to_string(list_filter([1, p_size, 3], lambda x: x <> 3), ',') AS re, array_to_string([p_size, p_size, p_size], ',') AS rp, array_to_string(list_sort(list_filter([1, 2, 3, 100], lambda x: x <> p_size AND x <> 1)), ',') AS ex, array_to_string(list_sort(list_intersect([1, 2, 3], [p_size, 1])), ',') AS it, array_to_string(list_sort(list_distinct([1, 2, p_size])), ',') AS un, CAST(list_position([5, p_size, 7], 7) AS BIGINT) AS po, CAST(p_size AS BIGINT) AS ca, list_has_any([1, 2, p_size], [30, 40]) AS ov, list_max([p_size, 25]) AS mx, array_to_string(string_split(p_brand, '#'), '|') AS sp, list_has_all([p_size, 1], [1, 2]) AS al FROM part",
    ),
    "fn_struct_map": (
        "SELECT n_nationkey, s.name AS name, s.k + 1 AS k, element_at(m, n_name) AS v, array_join(sort_array(map_keys(m)), ',') AS ks, array_join(sort_array(map_values(m)), ',') AS vs, CAST(cardinality(m) AS BIGINT) AS n, map_contains_key(m, 'x') AS has, element_at(m, 'none') IS NULL AS absent, struct(n_regionkey, n_name).n_name AS st FROM (SELECT *, named_struct('name', n_name, 'k', n_nationkey) AS s, map(n_name, n_regionkey, 'x', -1) AS m FROM nation)",
        "SELECT n_nationkey, s.name AS name, s.k + 1 AS k, m[n_name] AS v, array_to_string(list_sort(map_keys(m)), ',') AS ks, array_to_string(list_sort(map_values(m)), ',') AS vs, CAST(cardinality(m) AS BIGINT) AS n, map_contains(m, 'x') AS has, m['none'] IS NULL AS absent, n_name AS st FROM (SELECT *, struct_pack(name := n_name, k := n_nationkey) AS s, MAP([n_name, 'x'], [n_regionkey, -1]) AS m FROM nation)",
    ),
    "fn_decode": (
        "SELECT c_custkey, decode(encode(c_name, 'UTF-8'), 'UTF-8') AS d, CAST(unbase64(base64(encode(c_name, 'UTF-8'))) AS STRING) AS b, decode(unhex(hex(c_name)), 'UTF-8') AS h, sha1(c_name) AS s1, url_encode(c_mktsegment) AS ue FROM customer",
        "SELECT c_custkey, decode(encode(c_name)) AS d, decode(from_base64(base64(encode(c_name)))) AS b, c_name AS h, sha1(c_name) AS s1, url_encode(c_mktsegment) AS ue FROM customer",
    ),
    "fn_typeof": (
        "SELECT n_nationkey, CAST(n_nationkey AS STRING) AS s, CAST(n_nationkey AS DOUBLE) / 2 AS half, try_cast(n_name AS INT) AS bad, typeof(n_name) AS t1, typeof(n_nationkey) AS t2, typeof(CAST(n_nationkey AS DOUBLE)) AS t3, typeof(n_name = 'x') AS t4 FROM nation",
        "SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) AS s, CAST(n_nationkey AS DOUBLE) / 2 AS half, try_cast(n_name AS INT) AS bad, replace(lower(typeof(n_name)), 'varchar', 'string') AS t1, replace(lower(typeof(n_nationkey)), 'integer', 'int') AS t2, lower(typeof(CAST(n_nationkey AS DOUBLE))) AS t3, lower(typeof(n_name = 'x')) AS t4 FROM nation",
    ),
    # sketches against exact figures: within a tenth
    "agg_approx_distinct": (
        "SELECT l_returnflag, abs(approx_count_distinct(l_partkey) - count(DISTINCT l_partkey)) <= 0.1 * count(DISTINCT l_partkey) AS near, abs(percentile_approx(l_quantity, 0.5) - median(l_quantity)) <= 1 AS near_median, abs(approx_percentile(l_quantity, 0.9) - percentile(l_quantity, 0.9)) <= 1 AS near_p90 FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, true AS near, true AS near_median, true AS near_p90 FROM lineitem GROUP BY l_returnflag",
    ),
}

"""SQL (DuckDB) for the registered queries, on the given tables; written apart from the
Spark code: windows, joins and unnesting where that uses array expressions.

The prompts' wording in here is fixed values, written out once more so that the comparison
does not rest on the library's own."""

NL = "chr(10)"

# Samples of the nested table, one row each, rates cut to the shorter array.
SAMPLE = """
WITH pieces AS (SELECT *, string_split(text, '.') AS p FROM documents),
piece AS (
 SELECT doc_id, lang, source, len(p) AS n_pieces,
  generate_subscripts(p, 1) - 1 AS i, unnest(p) AS s FROM pieces),
sample AS (
 SELECT doc_id AS problem_id, source || '-' || doc_id AS canonical_id,
  'Write what text ' || doc_id || ' says in ' || lang AS prompt, i AS sample_idx, s AS piece,
  CASE i % 5
   WHEN 0 THEN '```python' || chr(10) || s || chr(10) || '```'
   WHEN 1 THEN 'so' || chr(10) || '```' || chr(10) || s || chr(10) || '```'
   WHEN 2 THEN '```python' || chr(10) || 'x = 1' || chr(10) || '```' || chr(10) || 'or'
    || chr(10) || '```python' || chr(10) || s || chr(10) || '```'
   ELSE s END AS output,
  CASE WHEN i % 5 > 2 THEN s
   WHEN i % 5 = 2 AND length(regexp_replace(s, '^\\s*\\n', '')) <= 5 THEN 'x = 1'
   ELSE trim(s, ' ' || chr(9) || chr(10) || chr(13)) END AS code,
  CASE WHEN doc_id % 11 = 0 THEN 1.0E0 WHEN doc_id % 13 = 0 THEN 0.0E0
   WHEN length(s) % 8 = 0 THEN NULL WHEN length(s) % 8 <= 3 THEN 1.0E0
   WHEN length(s) % 8 <= 5 THEN 0.0E0 ELSE 0.5E0 END AS pass_rate
 FROM piece WHERE doc_id % 17 <> 0 AND (doc_id % 7 <> 0 OR i < n_pieces - 1)),
valid AS (
 SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY sample_idx) - 1 AS position,
  count(*) OVER w AS n, min(pass_rate) OVER w AS lo, max(pass_rate) OVER w AS hi,
  avg(CASE WHEN pass_rate = 1 THEN 1.0E0 ELSE 0.0E0 END) OVER w AS share
 FROM sample WHERE pass_rate IS NOT NULL WINDOW w AS (PARTITION BY problem_id))
"""


def grouped(limit=1.0):
    return f"""{SAMPLE},
placed AS (
 SELECT *, CAST(floor(position / 4) AS BIGINT) AS group_idx, CAST(position % 4 AS INT) AS place
 FROM valid WHERE NOT (lo = 1 AND hi = 1) AND NOT (lo = 0 AND hi = 0) AND share <= {limit}
  AND floor(position / 4) < floor(n / 4)),
member AS (
 SELECT * FROM placed WINDOW g AS (PARTITION BY problem_id, group_idx)
 QUALIFY max(pass_rate) OVER g = 1 AND min(pass_rate) OVER g < 1),
grp AS (
 SELECT problem_id, group_idx, any_value(canonical_id) AS canonical_id,
  any_value(prompt) AS prompt, count(*) AS k,
  string_agg('--- CANDIDATE ' || (place + 1) || ' ---' || chr(10) || '```python' || chr(10)
   || code || chr(10) || '```' || chr(10), chr(10) ORDER BY place) AS block,
  '[' || string_agg(CAST(pass_rate AS VARCHAR), ', ' ORDER BY place) || ']' AS ground_truth
 FROM member GROUP BY problem_id, group_idx),
prompted AS (
 SELECT *, 'You will be given a question (problem specification) and ' || k
  || ' candidate solutions. You will analyze these candidates and RANK them from most likely'
  || ' to least likely to pass all tests. You will NOT return anything except for the ranking.'
  || chr(10) || chr(10) || 'Question: ' || prompt || chr(10) || chr(10) || block
  || chr(10) || chr(10) || 'Analyze each candidate solution, analyze all the strengths and'
  || ' weaknesses, and rank them from most effective to least effective. Output ONLY the'
  || ' ranking as comma-separated numbers from best to worst (e.g., "2, 4, 1, 3").'
  || chr(10) || chr(10) || 'Ranking (best to worst): ' AS content,
  row_number() OVER (ORDER BY problem_id, group_idx) - 1 AS index,
  md5('42|' || problem_id || '|' || group_idx) AS shuffle_key FROM grp),
labelled AS (
 SELECT *, CASE WHEN row_number() OVER (ORDER BY shuffle_key)
  <= floor((SELECT count(*) FROM grp) * (1 - 0.1E0)) THEN 'train' ELSE 'test' END AS split
 FROM prompted)
"""


GROUP_ROWS = "SELECT problem_id, group_idx, place, output AS candidate, code, pass_rate FROM member"

BY_PROBLEM = f"""{grouped()},
side AS (
 SELECT problem_id, md5('42|' || problem_id) AS shuffle_key,
  row_number() OVER (ORDER BY md5('42|' || problem_id))
   <= floor(count(*) OVER () * (1 - 0.1E0)) AS train
 FROM (SELECT DISTINCT problem_id FROM grp))
SELECT problem_id, group_idx, side.shuffle_key, CASE WHEN train THEN 'train' ELSE 'test' END AS split
FROM grp JOIN side USING (problem_id)
"""

FENCED = """
WITH c AS (SELECT doc_id AS problem_id, text, CASE doc_id % 7
 WHEN 0 THEN '```python' || chr(10) || text || chr(10) || '```'
 WHEN 1 THEN 'a' || chr(10) || '```' || chr(10) || text || chr(10) || '```'
 WHEN 2 THEN '```python' || chr(10) || 'x = 1' || chr(10) || '```' || chr(10) || 'or' || chr(10) || '```python' || chr(10) || text || chr(10) || '```'
 WHEN 3 THEN '```python' || chr(10) || text
 WHEN 4 THEN '   '
 WHEN 5 THEN text END AS completion FROM documents),
m AS (SELECT problem_id, completion,
 regexp_extract_all(completion, '```python\\s*\\n(.*?)\\n```', 1, 's') AS tagged,
 regexp_extract_all(completion, '```\\s*\\n(.*?)\\n```', 1, 's') AS bare FROM c),
body AS (SELECT problem_id, completion, CASE WHEN len(tagged) > 0 THEN tagged ELSE bare END AS b FROM m),
found AS (SELECT problem_id, completion, CASE WHEN len(b) > 0 THEN trim(
 list_filter(b, lambda x: length(x) = list_max(list_transform(b, lambda y: length(y))))[1],
 ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) END AS code FROM body)
"""

# Problems from orders, with the parts of the question already as text.
PROBLEM = """
WITH p AS (SELECT o_orderkey AS problem_id, o_custkey, o_orderstatus, o_orderpriority,
 CASE o_orderkey % 5
  WHEN 0 THEN 'def solve_' || o_custkey % 7 || '(a):'
  WHEN 1 THEN 'class S:' || chr(10) || '    def go_' || o_custkey % 7 || '(self, a):'
  WHEN 2 THEN 'def broken(' WHEN 3 THEN '' END AS starter_code,
 CASE o_orderkey % 5
  WHEN 0 THEN 'solve_' || o_custkey % 7
  WHEN 1 THEN 'go_' || o_custkey % 7 END AS function_name,
 CASE WHEN o_orderkey % 6 > 1 AND o_orderkey % 5 <= 1 THEN 'function' ELSE 'stdin' END AS problem_type
 FROM orders),
q AS (SELECT *, CASE WHEN problem_id % 11 = 0 THEN '' ELSE
 'Problem:' || chr(10) || 'Order ' || problem_id || ' ' || o_orderpriority
 || CASE WHEN o_orderstatus = 'O' THEN chr(10) || 'Input Format:' || chr(10) || 'one integer' ELSE '' END
 || CASE WHEN o_orderstatus <> 'P' THEN chr(10) || 'Output Format:' || chr(10) || 'one number' ELSE '' END
 || CASE WHEN o_custkey % 3 = 0 THEN chr(10) || 'Notes:' || chr(10) || o_orderpriority ELSE '' END
 || CASE problem_id % 4
  WHEN 2 THEN chr(10) || 'Sample Test Cases:' || chr(10) || chr(10) || 'Example 1:' || chr(10)
   || 'Input:' || chr(10) || o_custkey || 'Output:' || chr(10) || o_orderstatus
   || CASE WHEN problem_id % 3 = 0 THEN 'Explanation:' || chr(10) || 'as ordered' ELSE '' END
  WHEN 3 THEN chr(10) || 'Sample Test Cases:' || chr(10) || chr(10) || 'Example 1:' || chr(10)
   || 'Input:' || chr(10) || o_custkey || 'Output:' || chr(10) || o_orderstatus
   || 'Explanation:' || chr(10) || 'first' || chr(10) || 'Example 2:' || chr(10)
   || 'Output:' || chr(10) || o_orderpriority
  ELSE '' END
 || CASE WHEN problem_id % 5 <= 2 THEN chr(10) || 'Starter Code:' || chr(10) || '```python'
   || chr(10) || starter_code || chr(10) || '```' || chr(10) ELSE '' END END AS question FROM p)
"""


def generation_text(thinking):
    """The generation prompt, for a model that is a thinking one under the condition."""
    return f"""'You will be given a question (problem specification) and will generate a correct'
 || ' Python program that matches the specification and passes all tests.'
 || CASE WHEN {thinking} THEN '' ELSE ' You will NOT return anything except for the program.' END
 || chr(10) || 'Question: ' || question || chr(10) || chr(10)
 || CASE problem_type WHEN 'function' THEN
  'You will use the following starter code to write the solution to the problem and'
  || ' enclose your code within delimiters."' || chr(10) || '```python' || chr(10) || starter_code
 ELSE 'Read the inputs from stdin solve the problem and write the answer to stdout (do not'
  || ' directly test on the sample inputs). Enclose your code within delimiters as follows.'
  || ' Ensure that when the python program runs, it reads the inputs, runs the algorithm and'
  || ' writes output to STDOUT.' || chr(10) || '```python' || chr(10) || '  # YOUR CODE HERE'
  || chr(10) || '```' END"""


TESTS = """
WITH suite AS (
 SELECT doc_id AS problem_id, 0 AS suite, unnest(string_split(text, chr(10))) AS t,
  generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents
 UNION ALL
 SELECT doc_id, 1, unnest(string_split(text, '.')), generate_subscripts(string_split(text, '.'), 1)
 FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 9 <> 0),
test AS (
 SELECT problem_id, row_number() OVER (PARTITION BY problem_id ORDER BY suite, i) - 1 AS test_idx,
  CASE WHEN suite = 0 OR length(t) % 2 = 1 THEN t ELSE 'None' END AS input,
  CASE WHEN suite = 0 THEN CAST(length(t) AS VARCHAR) ELSE t END AS expected_output
 FROM suite)
"""

COMPLETION = """
completion AS (
 SELECT conv_id AS problem_id, turn AS sample_idx, text,
  CASE turn % 4 WHEN 0 THEN '```python' || chr(10) || text || chr(10) || '```'
   WHEN 1 THEN trim(text, ' ' || chr(9) || chr(10) || chr(13))
   WHEN 2 THEN '```' || chr(10) || text || chr(10) || '```' ELSE '' END AS output,
  CASE role WHEN 'assistant' THEN 'stop' ELSE 'length' END AS finish_reason,
  CASE WHEN turn % 2 = 0 THEN nullif(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '') END AS code
 FROM conversations),
problem AS (
 SELECT doc_id AS problem_id, floor(length(text) / 3) > 1600 AS over_budget,
  CASE WHEN doc_id % 3 = 0 THEN 'solve' END AS function_name FROM documents)
"""

# Raw problems through the three stages.
STAGES = f"""{TESTS}, {COMPLETION},
raw AS (
 SELECT doc_id AS problem_id, text, CASE WHEN doc_id % 3 = 0 THEN 'def solve(a):' END AS starter_code,
  CASE WHEN doc_id % 3 = 0 THEN 'function' ELSE 'stdin' END AS problem_type FROM documents),
asked AS (
 SELECT *, CASE WHEN text <> '' THEN 'Problem:' || chr(10) || text ELSE '' END
  || CASE WHEN starter_code IS NULL THEN '' ELSE chr(10) || 'Starter Code:' || chr(10) || '```python'
   || chr(10) || starter_code || chr(10) || '```' || chr(10) END AS question FROM raw),
sent AS (SELECT problem_id, floor(length({generation_text("false")}) / 3) > 1600 AS over_budget FROM asked),
taken AS (SELECT c.* FROM completion c JOIN sent USING (problem_id) WHERE NOT over_budget),
rate AS (
 SELECT problem_id, sample_idx, avg(CASE WHEN (problem_id + sample_idx) % 4 < 2
   OR (problem_id + sample_idx + test_idx) % 7 < 3 THEN 1.0E0 ELSE 0.0E0 END) AS pass_rate
 FROM taken JOIN test USING (problem_id) WHERE code IS NOT NULL GROUP BY 1, 2)
"""

RUNS = """
WITH run AS (
 SELECT l_partkey AS problem_id, CAST(l_linenumber AS BIGINT) AS sample_idx,
  l_orderkey * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS test_idx,
  (l_linestatus = 'F' OR test_idx % 7 <> 0) AND l_suppkey % 50 <> 0 AND l_discount >= 0.005
   AND l_discount <= 0.085 AND l_tax < 0.05 AS passed, l_returnflag <> 'R' AS has_code FROM lineitem),
rate AS (
 SELECT problem_id, sample_idx,
  avg(CASE WHEN has_code THEN CASE WHEN passed THEN 1.0E0 ELSE 0.0E0 END END) AS pass_rate
 FROM run GROUP BY 1, 2)
"""

# Rollouts and their responses.
SAID = """
WITH base AS MATERIALIZED (
 SELECT o_orderkey AS problem_id, CAST(r AS BIGINT) AS rollout_idx, o_custkey,
  o_orderstatus AS generator, o_orderpriority AS difficulty,
  CAST(month(o_orderdate) * 10 AS INT) AS step, CAST(3 + o_orderkey % 3 AS INT) AS n,
  ([(o_custkey % 4) / 3.0E0, (o_custkey // 4 % 4) / 3.0E0, (o_custkey // 16 % 4) / 3.0E0,
   (o_orderkey % 4) / 3.0E0, (o_orderkey // 4 % 4) / 3.0E0])[1:CAST(3 + o_orderkey % 3 AS INT)] AS rates
 FROM orders, unnest(range(8)) AS t(r)),
perm AS (
 SELECT *, list_transform(range(n), lambda i: CAST((CASE WHEN o_custkey % 2 = 0
   THEN problem_id + rollout_idx + i ELSE problem_id + rollout_idx + n - i END) % n + 1 AS VARCHAR)) AS ids
 FROM base),
said AS MATERIALIZED (
 SELECT *, CASE rollout_idx
  WHEN 0 THEN array_to_string(ids, ', ')
  WHEN 1 THEN array_to_string(list_reverse(ids), ' > ')
  WHEN 2 THEN '<think>1, 2</think> ' || array_to_string(ids, ',')
  WHEN 3 THEN array_to_string(ids[1:n - 1], ', ')
  WHEN 4 THEN 'no ranking'
  WHEN 5 THEN 'Best: ' || ids[1] || ' ' || array_to_string(ids, ' ') || ' then 12345'
  WHEN 6 THEN (n + 1) || ', 0, ' || array_to_string(ids, ', ')
  ELSE '00002, ' || array_to_string(list_filter(ids, lambda d: d <> '2'), ', ') END AS response
 FROM perm)
"""

# Rankings, worked out by unnesting the numbers of a response.
PLACED = f"""{SAID},
number AS (
 SELECT problem_id, rollout_idx, n, unnest(nums) AS d, generate_subscripts(nums, 1) AS seen FROM (
  SELECT problem_id, rollout_idx, n,
   regexp_extract_all(string_split(response, '</think>')[-1], '[0-9]+') AS nums FROM said)),
choice AS (
 SELECT problem_id, rollout_idx, CAST(d AS INT) AS id, min(seen) AS seen, any_value(n) AS n
 FROM number WHERE length(d) <= 4 AND CAST(d AS INT) BETWEEN 1 AND n GROUP BY 1, 2, 3),
placed AS MATERIALIZED (
 SELECT problem_id, rollout_idx, id, row_number() OVER (PARTITION BY problem_id, rollout_idx ORDER BY seen) AS place
 FROM choice QUALIFY count(*) OVER (PARTITION BY problem_id, rollout_idx) = n)
"""

RANKED = f"""{PLACED},
rel AS MATERIALIZED (
 SELECT b.problem_id, b.rollout_idx, p.id, p.place, b.rates[p.id] AS rate,
  row_number() OVER (PARTITION BY b.problem_id, b.rollout_idx ORDER BY b.rates[p.id] DESC) AS best
 FROM base b JOIN placed p USING (problem_id, rollout_idx)),
gain AS MATERIALIZED (
 SELECT problem_id, rollout_idx, string_agg(CAST(id - 1 AS VARCHAR), ' ' ORDER BY place) AS ranking,
  sum((pow(2, rate) - 1) / log2(place + 1)) AS dcg, sum((pow(2, rate) - 1) / log2(best + 1)) AS idcg,
  sum(CASE WHEN place <= 2 THEN (pow(2, rate) - 1) / log2(place + 1) ELSE 0 END) AS dcg2,
  sum(CASE WHEN best <= 2 THEN (pow(2, rate) - 1) / log2(best + 1) ELSE 0 END) AS idcg2,
  max(rate) AS hi, min(rate) AS lo, max(CASE WHEN place = 1 THEN rate END) AS first
 FROM rel GROUP BY 1, 2),
pair AS (
 SELECT a.problem_id, a.rollout_idx, avg(CASE WHEN a.place < b.place THEN 1.0E0 ELSE 0.0E0 END) AS share
 FROM rel a JOIN rel b ON a.problem_id = b.problem_id AND a.rollout_idx = b.rollout_idx AND a.rate > b.rate
 GROUP BY 1, 2),
metric AS (
 SELECT g.*, CASE WHEN idcg = 0 THEN 1.0E0 ELSE dcg / idcg END AS ndcg,
  CASE WHEN idcg2 = 0 THEN 1.0E0 ELSE dcg2 / idcg2 END AS ndcg2,
  coalesce(share, 1.0E0) AS pairacc,
  CASE WHEN hi = lo OR first = hi THEN 1.0E0 ELSE 0.0E0 END AS top1_acc
 FROM gain g LEFT JOIN pair USING (problem_id, rollout_idx)),
scored AS (
 SELECT b.*, coalesce(pairacc, -1.0E0) AS score, coalesce(m.ndcg, -1.0E0) AS ndcg,
  coalesce(m.pairacc, -1.0E0) AS pairacc, coalesce(m.top1_acc, -1.0E0) AS top1_acc, m.first, m.ranking
 FROM base b LEFT JOIN metric m USING (problem_id, rollout_idx))
"""

# The same row by row, in list functions alone.
LISTED = f"""{SAID},
numbers AS (
 SELECT *, list_filter(list_transform(list_filter(
   regexp_extract_all(string_split(response, '</think>')[-1], '[0-9]+'), lambda d: length(d) <= 4),
   lambda d: CAST(d AS INT)), lambda d: d >= 1 AND d <= n) AS seen FROM said),
listed AS (
 SELECT *, list_filter(seen, lambda d, i: list_position(seen, d) = i) AS chosen FROM numbers),
judged AS (
 SELECT *, CASE WHEN len(chosen) = n THEN list_transform(chosen, lambda d: rates[d]) END AS rel,
  list_reverse_sort(rates) AS best FROM listed),
summed AS (
 SELECT *, list_sum(list_transform(rel, lambda r, i: (pow(2, r) - 1) / log2(i + 1))) AS dcg,
  list_sum(list_transform(best, lambda r, i: (pow(2, r) - 1) / log2(i + 1))) AS idcg,
  list_sum(list_transform(rel, lambda a, i: len(list_filter(rel[i + 1:], lambda b: b < a)))) AS better,
  list_sum(list_transform(rel, lambda a, i: len(list_filter(rel[i + 1:], lambda b: b <> a)))) AS unequal
 FROM judged),
scores AS (
 SELECT problem_id, rollout_idx, array_to_string(list_transform(chosen, lambda d: d - 1), ' ') AS ranking, rel,
  CASE WHEN rel IS NULL THEN -1.0E0 WHEN idcg = 0 THEN 1.0E0 ELSE dcg / idcg END AS ndcg,
  CASE WHEN rel IS NULL THEN -1.0E0 WHEN unequal = 0 THEN 1.0E0 ELSE better / unequal END AS pairacc,
  CASE WHEN rel IS NULL THEN -1.0E0 WHEN rel[1] = best[1] THEN 1.0E0 ELSE 0.0E0 END AS top1_acc FROM summed)
"""

METRIC = """
WITH metric AS (
 SELECT CAST(extract(day FROM ts) AS INT) * 10 AS step, CAST(user_id % 10 AS INT) AS repeat_idx,
  event_type AS metric, avg(value) AS value FROM events GROUP BY 1, 2, 3)
"""

# What the derived result files hold: kind 3 has no metrics, kind 1 adds an accuracy.
FILES = f"""{METRIC},
run AS (SELECT step, repeat_idx, (step // 10 + repeat_idx) % 4 AS kind,
 string_agg('"' || metric || '":', '' ORDER BY metric) AS names FROM metric GROUP BY 1, 2),
value AS (
 SELECT step, repeat_idx, metric, value FROM metric JOIN run USING (step, repeat_idx) WHERE kind < 3
 UNION ALL SELECT step, repeat_idx, 'passed', 1.0E0 FROM run WHERE kind < 3
 UNION ALL SELECT step, repeat_idx, 'accuracy', 0.25E0 FROM run WHERE kind = 1)
"""

SUMMARY = """SELECT step, metric, round(avg(value), 9) AS mean,
 round(CASE WHEN count(value) > 1 THEN stddev_pop(value) / sqrt(count(value)) ELSE 0.0E0 END, 9) AS stderr,
 count(value) AS n"""


def oracle_sql():
    groups = grouped()
    return {
        "candidate_groups": f"{groups} {GROUP_ROWS}",
        "candidate_groups_nested": f"{groups} {GROUP_ROWS}",
        "candidate_groups_with_problems": f"""{groups}
            SELECT problem_id, group_idx, canonical_id, prompt, ground_truth FROM grp""",
        "valid_candidates": f"""{SAMPLE}
            SELECT problem_id, CAST(position AS INT) AS place, output, pass_rate FROM valid""",
        "max_pass_ratio": f"{grouped(0.35)} {GROUP_ROWS}",
        "grouping_stats": f"""{grouped(0.35)},
            seen AS (SELECT DISTINCT problem_id, lo, hi, share FROM valid),
            c AS (SELECT (SELECT count(*) FROM grp) AS total_groups, count(*) AS total_queries, count(*) FILTER (lo = 1 AND hi = 1) AS all_correct,
             count(*) FILTER (lo = 0 AND hi = 0) AS all_wrong,
             count(*) FILTER (share > 0.35 AND lo < 1) AS high_ratio FROM seen)
            SELECT *, total_queries - all_correct - all_wrong - high_ratio AS remaining,
             round(100 * all_correct / greatest(total_queries, 1), 9) AS all_correct_pct,
             round(100 * all_wrong / greatest(total_queries, 1), 9) AS all_wrong_pct,
             round(100 * remaining / greatest(total_queries, 1), 9) AS remaining_pct,
             round(total_groups / greatest(remaining, 1), 9) AS groups_per_query FROM c""",
        "grouped_table": f"""{groups},
            seen AS (SELECT DISTINCT problem_id, lo, hi FROM valid)
            SELECT count(*) AS total_queries, count(*) FILTER (lo = 1 AND hi = 1) AS all_correct,
             count(*) FILTER (lo = 0 AND hi = 0) AS all_wrong,
             count(*) FILTER (NOT (lo = 1 AND hi = 1) AND NOT (lo = 0 AND hi = 0)) AS remaining,
             (SELECT count(*) FROM grp) AS total_groups FROM seen""",
        "verify_join": f"""{RUNS}
            SELECT problem_id, sample_idx, test_idx, passed FROM run WHERE has_code""",
        "pass_rate": f"""{RUNS}
            SELECT problem_id, sample_idx, round(pass_rate, 9) AS pass_rate FROM rate""",
        "verification_counts": f"""{RUNS}
            SELECT count(pass_rate) AS verified, count(*) AS samples FROM rate""",
        "verified_tests": f"""{TESTS}, {COMPLETION}
            SELECT problem_id, sample_idx, test_idx, (problem_id + sample_idx) % 4 < 2
             OR (problem_id + sample_idx + test_idx) % 7 < 3 AS passed
            FROM completion JOIN test USING (problem_id) WHERE code IS NOT NULL""",
        "flatten_test_cases": f"{TESTS} SELECT problem_id, test_idx, input, expected_output FROM test",
        "capped_test_cases": f"{TESTS} SELECT problem_id, test_idx, input, expected_output FROM test WHERE test_idx < 50",
        "execution_worklist": f"""{TESTS}, {COMPLETION}
            SELECT problem_id, sample_idx, test_idx, code, function_name, input, expected_output
            FROM completion JOIN problem USING (problem_id) JOIN test USING (problem_id)
            WHERE code IS NOT NULL""",
        "execution_programs": f"""{TESTS}, {COMPLETION}
            SELECT problem_id, sample_idx, test_idx, md5(CASE WHEN function_name IS NULL THEN code ELSE
             code || chr(10) || chr(10) || 'import io, sys' || chr(10) || '_given = ' || CAST(to_json(input) AS VARCHAR)
             || chr(10) || 'sys.stdin = io.StringIO(_given)' || chr(10) || '_returned = ' || function_name
             || '(*_given.strip().split(chr(10)))' || chr(10) || 'if _returned is not None:' || chr(10)
             || '    print(_returned)' || chr(10) END) AS program_md5,
             CASE WHEN function_name IS NULL THEN input ELSE '' END AS stdin
            FROM completion JOIN problem USING (problem_id) JOIN test USING (problem_id)
            WHERE code IS NOT NULL""",
        "attach_completions": f"""WITH {COMPLETION}
            SELECT p.problem_id, coalesce(c.sample_idx, -1) AS sample_idx, c.output, c.finish_reason, p.over_budget
            FROM problem p LEFT JOIN completion c ON p.problem_id = c.problem_id AND NOT p.over_budget""",
        "generate_and_verify": f"""{TESTS}, {COMPLETION},
            kept AS (SELECT c.* FROM completion c JOIN problem p USING (problem_id) WHERE NOT over_budget),
            rate AS (SELECT problem_id, sample_idx, avg(CASE WHEN
              (problem_id + sample_idx + test_idx) % 7 IN (1, 2) THEN 1.0E0 ELSE 0.0E0 END) AS pass_rate
             FROM kept JOIN test USING (problem_id) WHERE code IS NOT NULL GROUP BY 1, 2)
            SELECT p.problem_id, count(k.sample_idx) AS n_outputs, count(r.pass_rate) AS n_rated,
             round(coalesce(sum(r.pass_rate), 0), 9) AS sum_rates
            FROM problem p LEFT JOIN kept k USING (problem_id) LEFT JOIN rate r USING (problem_id, sample_idx)
            GROUP BY 1""",
        "parse_ranking": f"""{LISTED} SELECT problem_id, rollout_idx,
            CASE WHEN rel IS NOT NULL THEN ranking END AS ranking FROM scores""",
        "ndcg": f"{RANKED} SELECT problem_id, rollout_idx, round(ndcg, 9) AS ndcg FROM metric",
        "ndcg_at_2": f"{RANKED} SELECT problem_id, rollout_idx, round(ndcg2, 9) AS ndcg FROM metric",
        "pairacc": f"{RANKED} SELECT problem_id, rollout_idx, round(pairacc, 9) AS pairacc FROM metric",
        "top1_acc": f"{RANKED} SELECT problem_id, rollout_idx, round(top1_acc, 9) AS top1_acc FROM metric",
        "reward": f"""{LISTED} SELECT problem_id, rollout_idx, round(pairacc, 9) AS score,
            round(ndcg, 9) AS ndcg, round(pairacc, 9) AS pairacc, round(top1_acc, 9) AS top1_acc FROM scores""",
        "reward_by_ndcg": f"{LISTED} SELECT problem_id, rollout_idx, round(ndcg, 9) AS score FROM scores",
        "reward_from_file": f"""{SAID},
            named AS (SELECT *, list_filter(list_transform(
              regexp_extract_all(string_split(response, '</think>')[-1], '[0-9]+'), lambda d: CAST(d AS INT)),
              lambda d: d <= n)[1] AS first FROM said)
            SELECT problem_id, rollout_idx, CASE WHEN first = 0 THEN -1.0E0 WHEN first > 0 THEN round(rates[first], 9) END AS score,
             CASE WHEN first IS NOT NULL THEN CAST(step AS DOUBLE) END AS step, CASE WHEN first IS NOT NULL THEN 1.0E0 END AS known,
             CASE WHEN first IS NULL THEN 'ValueError: no candidate named' END AS reward_error FROM named""",
        "reward_summary": f"""{RANKED} SELECT step, count(*) AS n, round(avg(score), 9) AS mean_score,
            round(avg(ndcg), 9) AS mean_ndcg, round(avg(pairacc), 9) AS mean_pairacc,
            round(avg(top1_acc), 9) AS mean_top1_acc,
            round(avg(CASE WHEN score = -1 THEN 1.0E0 ELSE 0.0E0 END), 9) AS parse_failure_share
            FROM scored GROUP BY step""",
        "group_advantage": f"""{RANKED} SELECT problem_id, rollout_idx, round(CASE
            WHEN min(score) OVER w = max(score) OVER w THEN 0.0E0
            ELSE (score - avg(score) OVER w) / stddev_samp(score) OVER w END, 9) AS advantage
            FROM scored WINDOW w AS (PARTITION BY problem_id)""",
        "selection_report": f"""{RANKED} SELECT step, generator,
            CASE WHEN rollout_idx % 2 = 0 THEN 'base' ELSE 'ckpt' END AS ranker, difficulty, count(*) AS n,
            round(avg(CASE WHEN first = 1 THEN 1.0E0 ELSE 0.0E0 END), 9) AS selected_pass,
            round(avg(len(list_filter(rates, lambda r: r = 1)) / n), 9) AS pass_at_1,
            round(avg(CASE WHEN list_contains(rates, 1.0E0) THEN 1.0E0 ELSE 0.0E0 END), 9) AS upper_bound
            FROM scored GROUP BY 1, 2, 3, 4""",
        "normalize_problem_type": f"{PROBLEM} SELECT problem_id, problem_type FROM p",
        "entry_function_name": f"{PROBLEM} SELECT problem_id, function_name FROM p",
        "assemble_question": f"{PROBLEM} SELECT problem_id, question FROM q",
        "generation_prompt": f"""{PROBLEM}
            SELECT problem_id, {generation_text("o_custkey % 2 = 1")} AS prompt FROM q""",
        "prepared_problems": f"""{PROBLEM}, r AS (SELECT *, {generation_text("false")} AS prompt FROM q)
            SELECT problem_id, problem_type, prompt, CAST(floor(length(prompt) / 3) AS BIGINT) AS token_estimate,
             floor(length(prompt) / 3) > 208 AS over_budget, 'm-instruct-1' AS generated_with FROM r""",
        "prompt_budget": """SELECT doc_id, CAST(floor(length(text) / 3) AS BIGINT) AS token_estimate,
            floor(length(text) / 3) > 1600 AS over_budget,
            CASE WHEN floor(length(text) / 3) > 1600 THEN 0 ELSE len(string_split(text, '.')) END
             AS n_outputs FROM documents""",
        "extract_code_strict": f"{FENCED} SELECT problem_id, code FROM found",
        "extract_code_lenient": f"{FENCED} SELECT problem_id, coalesce(code, completion) AS code FROM found",
        "limit_problems": f"""{PROBLEM} SELECT problem_id, starter_code FROM p
            ORDER BY problem_id LIMIT 100""",
        "candidate_block": f"{groups} SELECT problem_id, group_idx, block FROM grp",
        "ranking_prompt": f"{groups} SELECT problem_id, group_idx, content FROM prompted",
        "record_index": f"{groups} SELECT problem_id, group_idx, index FROM prompted",
        "training_record": f"""{groups} SELECT problem_id, group_idx, 'code_ranking' AS data_source,
            'code_ranking' AS ability, 'user' AS role, content, 'rule' AS style, ground_truth, index,
            CAST(k AS INT) AS n_candidates FROM prompted""",
        "overlong_filter": f"""{groups} SELECT problem_id, group_idx,
            CAST(floor(length(content) / 3) AS BIGINT) AS tokens FROM prompted
            WHERE floor(length(content) / 3) <= 400""",
        "length_check": """SELECT count(*) AS violations FROM documents
            WHERE doc_id % 7 = 0 AND doc_id % 17 <> 0""",
        "train_val_split": f"""{groups}
            SELECT problem_id, group_idx, shuffle_key, split FROM labelled""",
        "train_val_split_by_problem": BY_PROBLEM,
        "split_counts": f"{groups} SELECT split, count(*) AS n FROM labelled GROUP BY split",
        "group_and_split": f"""{groups} SELECT index, split, ground_truth, length(content) AS n_chars
            FROM labelled""",
        "problems_to_records": f"""{STAGES},
            valid AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY sample_idx) - 1 AS position,
              count(*) OVER w AS n, min(pass_rate) OVER w AS lo, max(pass_rate) OVER w AS hi
             FROM rate WINDOW w AS (PARTITION BY problem_id)),
            grp AS (SELECT problem_id, CAST(position // 2 AS BIGINT) AS group_idx, sum(pass_rate) AS total
             FROM valid WHERE NOT (lo = 1 AND hi = 1) AND NOT (lo = 0 AND hi = 0) GROUP BY 1, 2
             HAVING count(*) = 2 AND max(pass_rate) = 1 AND min(pass_rate) < 1)
            SELECT row_number() OVER (ORDER BY problem_id, group_idx) - 1 AS index,
             CASE WHEN row_number() OVER (ORDER BY md5('42|' || problem_id || '|' || group_idx))
              <= floor(count(*) OVER () * (1 - 0.3E0)) THEN 'train' ELSE 'test' END AS split,
             2 AS n_candidates, round(total, 9) AS sum_rates FROM grp""",
        "generate_unverified": f"""{STAGES}
            SELECT s.problem_id, 'd-' || s.problem_id AS canonical_id, CAST(1 AS BIGINT) AS n_parts,
             count(t.sample_idx) AS n_outputs, CAST(0 AS BIGINT) AS n_rated
            FROM sent s LEFT JOIN taken t USING (problem_id) GROUP BY s.problem_id""",
        "generate_in_shards": f"""{STAGES}
            SELECT s.problem_id, 'd-' || s.problem_id AS canonical_id, count(t.sample_idx) AS n_outputs
            FROM sent s LEFT JOIN taken t USING (problem_id) GROUP BY s.problem_id""",
        "columns_by_file": f"""
            SELECT 'train-00' || (doc_id % 3) AS shard, gone AS "column", count(*) AS n_rows FROM documents
            JOIN (VALUES (1, 'self_distillation_outputs'), (2, 'prompt'), (2, 'self_distillation_pass_rates')) AS g(k, gone)
             ON doc_id % 3 = k GROUP BY 1, 2""",
        "scan_required_columns": f"""{SAMPLE}
            SELECT CASE WHEN problem_id % 3 = 0 THEN any_value(canonical_id) END AS canonical_id,
             any_value(prompt) AS prompt, CAST(count(*) AS INT) AS n_valid FROM valid
            WHERE problem_id % 3 = 0 OR (problem_id % 3 = 2 AND problem_id % 2 = 0) GROUP BY problem_id""",
        "json_array_column": f"""{groups}
            SELECT problem_id, group_idx, place, code, pass_rate FROM member""",
        "result_json_scan": f"""{FILES}
            SELECT step, repeat_idx, CAST(length('{{,"_seed":7,"passed":true,"note":"0.5"}}')
             + CASE kind WHEN 1 THEN length('"accuracy":0.25,') ELSE 0 END
             + (SELECT sum(length('"' || metric || '":' || CAST(value AS VARCHAR)) + 1) - 1 FROM metric m
                WHERE m.step = run.step AND m.repeat_idx = run.repeat_idx) AS BIGINT) AS n_chars
            FROM run WHERE kind < 3""",
        "extract_metrics": f"""{FILES}
            SELECT step, repeat_idx, metric, round(value, 9) AS value FROM value""",
        "sweep_summary": f"{METRIC} {SUMMARY} FROM metric GROUP BY 1, 2",
        "summary_order": f"""{METRIC}, summary AS ({SUMMARY} FROM metric GROUP BY 1, 2),
            shown AS (SELECT metric, CAST(row_number() OVER (ORDER BY metric) - 1 AS INT) AS place
             FROM summary WHERE step = (SELECT min(step) FROM summary) QUALIFY place < 5)
            SELECT step, place, metric, mean, stderr, n FROM summary JOIN shown USING (metric)""",
        "sweep_report": f"{FILES} {SUMMARY} FROM value GROUP BY 1, 2",
        "missing_runs": f"""{METRIC},
            grid AS (SELECT CAST(s AS INT) AS step, CAST(r AS INT) AS repeat_idx
             FROM (SELECT unnest(range(5, (SELECT max(step) FROM metric) + 1, 5)) AS s),
              (SELECT unnest(range(12)) AS r))
            SELECT step, repeat_idx FROM grid ANTI JOIN metric USING (step, repeat_idx)""",
    }

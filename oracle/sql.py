"""Independent DuckDB SQL for every registered query (the correctness oracle).

Written from the operator definitions, not from the Spark code: plain window
SQL, GROUP BYs and joins over the pre-registered views. Doubles are rounded to
6 places on both sides. CTE fragments are composed with ``with_(...)``.
"""

from __future__ import annotations

# thresholds of the registered queries: the cell minimums are 5
MS = 5          # min_samples
MT = 5          # treated prefilter
R6 = 6          # rounding places


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# events -> submissions, DuckDB form
SUBS = """subs AS (
  WITH e AS (
    SELECT CAST(user_id AS VARCHAR) AS handle, epoch_us(ts) AS time, event_type,
           CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS kk
    FROM events),
  d AS (
    SELECT *, CASE event_type WHEN 'purchase' THEN 25 WHEN 'signup' THEN 10 WHEN 'view' THEN 0
                              WHEN 'click' THEN -10 ELSE -25 END
            + CASE kk WHEN 0 THEN 40 WHEN 1 THEN 20 WHEN 8 THEN -20 WHEN 9 THEN -40 ELSE 0 END AS step
    FROM e)
  SELECT handle, time,
         'P' || lpad(CAST(kk AS VARCHAR), 2, '0') AS id_of_submission_task,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'OK' ELSE 'WRONG_ANSWER' END AS verdict,
         CAST(1500 + coalesce(sum(step) OVER (PARTITION BY handle ORDER BY time, kk NULLS FIRST, event_type NULLS FIRST
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS rating_at_submission,
         CASE WHEN kk = 7 THEN NULL ELSE CAST(1000 + 100 * kk AS DOUBLE) END AS problem_rating
  FROM d)"""

CLEAN = """clean AS (
  SELECT * FROM subs WHERE rating_at_submission IS NOT NULL
     AND rating_at_submission >= {lo} AND rating_at_submission <= 4000)"""

META = """meta AS (
  SELECT *,
         CASE WHEN est IS NULL THEN NULL ELSE least(greatest(est, 800.0), 4000.0) END AS estimated_difficulty,
         acceptance_rate >= 0.05 AS stable_acceptance
  FROM (
    SELECT *, total_submissions >= 50 AS has_sufficient_support,
           CASE WHEN avg_provided_rating IS NOT NULL
                THEN 0.7 * avg_provided_rating + (1 - 0.7) * avg_solver_rating
                ELSE avg_solver_rating END AS est,
           CASE WHEN total_submissions = 0 THEN 0.0
                ELSE ok_count::DOUBLE / total_submissions END AS acceptance_rate
    FROM (
      SELECT id_of_submission_task,
             avg(problem_rating) AS avg_provided_rating,
             avg(CASE WHEN verdict = 'OK' THEN rating_at_submission END) AS avg_solver_rating,
             count(verdict) AS total_submissions,
             count(*) FILTER (WHERE verdict = 'OK') AS ok_count
      FROM clean GROUP BY id_of_submission_task)))"""

FEAT = """feat AS (
  WITH j AS (
    SELECT c.*, m.estimated_difficulty,
           CAST(c.verdict = 'OK' AS INTEGER) AS ok
    FROM clean c LEFT JOIN meta m USING (id_of_submission_task)),
  r AS (
    SELECT *,
      CASE WHEN count(ok) OVER h = 20 THEN avg(ok) OVER h END AS roll_acc_20,
      CASE WHEN count(ok) OVER h = 20 THEN sum(ok) OVER h END AS roll_solve_cnt_20,
      CASE WHEN count(ok) OVER h = 20 THEN sum(coalesce(estimated_difficulty, 0.0) * ok) OVER h END AS wsum,
      time - lag(time) OVER w AS time_since_last_sub,
      CASE WHEN count(*) OVER h = 20 THEN count(*) OVER h END AS roll_sub_cnt_20,
      rating_at_submission - lag(rating_at_submission) OVER w AS d
    FROM j
    WINDOW w AS (PARTITION BY handle ORDER BY time, id_of_submission_task NULLS FIRST, verdict NULLS FIRST, rating_at_submission NULLS FIRST, problem_rating NULLS FIRST),
           h AS (PARTITION BY handle ORDER BY time, id_of_submission_task NULLS FIRST, verdict NULLS FIRST, rating_at_submission NULLS FIRST, problem_rating NULLS FIRST ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
  r2 AS (
    SELECT *,
      CASE WHEN count(d) OVER (PARTITION BY handle ORDER BY time, id_of_submission_task NULLS FIRST, verdict NULLS FIRST, rating_at_submission NULLS FIRST, problem_rating NULLS FIRST ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 20
           THEN avg(d) OVER (PARTITION BY handle ORDER BY time, id_of_submission_task NULLS FIRST, verdict NULLS FIRST, rating_at_submission NULLS FIRST, problem_rating NULLS FIRST ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
      END AS roll_rating_delta_20
    FROM r)
  SELECT handle, time, id_of_submission_task, verdict, rating_at_submission, problem_rating,
         estimated_difficulty, roll_acc_20, CAST(roll_solve_cnt_20 AS INTEGER) AS roll_solve_cnt_20,
         time_since_last_sub, CAST(roll_sub_cnt_20 AS INTEGER) AS roll_sub_cnt_20,
         CASE WHEN roll_solve_cnt_20 IS NULL OR roll_solve_cnt_20 = 0 OR wsum IS NULL THEN 0.0
              ELSE wsum / roll_solve_cnt_20 END AS roll_ok_diff_20,
         roll_rating_delta_20
  FROM r2 WHERE roll_sub_cnt_20 >= 10)"""

# C1 + C2: outcome 20 feature rows later, bins (half away from zero, as DuckDB round)
CEM = """cem AS (
  SELECT *, CAST(round(rating_at_submission / 100) AS INTEGER) AS bin_rating,
            CAST(round(roll_acc_20 * 10) AS INTEGER) AS bin_acc,
            CAST(round(CASE WHEN isnan(roll_ok_diff_20) OR isinf(roll_ok_diff_20) THEN 0.0
                            ELSE roll_ok_diff_20 END / 200) AS INTEGER) AS bin_diff
  FROM (
    SELECT *, future_rating_20 - rating_at_submission AS rating_gain_20,
           CAST(future_rating_20 - rating_at_submission > 0 AS INTEGER) AS improved_20
    FROM (SELECT *, lead(rating_at_submission, 20) OVER (PARTITION BY handle ORDER BY time, id_of_submission_task NULLS FIRST, verdict NULLS FIRST, rating_at_submission NULLS FIRST, problem_rating NULLS FIRST) AS future_rating_20
          FROM feat))
  WHERE rating_gain_20 IS NOT NULL)"""

BASE = f"""base AS (
  SELECT bin_rating, bin_acc, bin_diff, avg(rating_gain_20) AS baseline_gain,
         stddev_samp(rating_gain_20) AS baseline_std, count(rating_gain_20) AS baseline_count,
         avg(improved_20) AS baseline_improve_prob
  FROM cem GROUP BY bin_rating, bin_acc, bin_diff HAVING count(rating_gain_20) >= {MS})"""

TREAT = f"""treat AS (
  SELECT id_of_submission_task, bin_rating, bin_acc, bin_diff, avg(rating_gain_20) AS treated_gain,
         stddev_samp(rating_gain_20) AS treated_std, count(rating_gain_20) AS treated_count,
         avg(improved_20) AS treated_improve_prob
  FROM cem GROUP BY id_of_submission_task, bin_rating, bin_acc, bin_diff
  HAVING count(rating_gain_20) >= {MT})"""

EFF = f"""eff AS (
  SELECT *, treated_count::DOUBLE / total_treated_samples AS weight
  FROM (
    SELECT *, sum(treated_count) OVER (PARTITION BY id_of_submission_task) AS total_treated_samples
    FROM (
      SELECT t.id_of_submission_task, t.bin_rating, t.bin_acc, t.bin_diff,
             treated_gain, treated_std, treated_count, treated_improve_prob,
             baseline_gain, baseline_std, baseline_count, baseline_improve_prob,
             treated_gain - baseline_gain AS uplift,
             treated_std ^ 2 / treated_count + baseline_std ^ 2 / baseline_count AS bucket_variance,
             treated_improve_prob - baseline_improve_prob AS probability_uplift
      FROM treat t JOIN base b ON t.bin_rating = b.bin_rating AND t.bin_acc = b.bin_acc
                               AND t.bin_diff = b.bin_diff
      WHERE treated_count >= {MS} AND baseline_count >= {MS}
        AND abs(treated_gain - baseline_gain) <= 300)))"""

ATT = """att AS (
  SELECT id_of_submission_task, sum(weight * uplift) AS att_score,
         sum(weight ^ 2 * bucket_variance) AS att_variance,
         max(total_treated_samples) AS total_treated_samples,
         avg(bin_rating) AS avg_rating_level,
         sum(probability_uplift * treated_count) / sum(treated_count) AS att_probability_uplift
  FROM eff GROUP BY id_of_submission_task)"""


def p_of(z: str) -> str:
    """Two-sided normal p = erfc(|z|/sqrt 2) by the Gamma series (independent of the Spark form).
    |z| > 6 gives p < 2e-9, i.e. 0 after rounding; x = 0 gives 1."""
    x = f"(abs({z}) / sqrt(2.0))"
    series = (f"list_sum(list_transform(range(0, 150), "
              f"lambda n: exp((2 * n + 1) * ln({x}) - lgamma(n + 1.5))))")
    return (f"CASE WHEN {z} IS NULL OR isnan({z}) THEN NULL WHEN abs({z}) > 6 THEN 0.0 "
            f"WHEN {z} = 0 THEN 1.0 ELSE 1 - exp(-{x} * {x}) * {series} END")


def t_p_of(t: str, df: str) -> str:
    """Two-sided Student p by the power series of the incomplete beta function I_y(1/2, df/2) at
    y = t^2 / (df + t^2), its terms in closed form with lgamma (independent of the Spark form)."""
    y, a = f"({t} * {t} / ({df} + {t} * {t}))", f"({df} / 2)"
    series = (f"list_sum(list_transform(range(0, 4000), lambda n: exp((n + 0.5) * ln({y}) + {a} * ln(1 - {y}) "
              f"+ lgamma({a} + n + 0.5) - lgamma({a}) - lgamma(n + 1.5))))")
    return (f"CASE WHEN {t} IS NULL OR {df} IS NULL OR isnan({t}) THEN NULL WHEN isinf({t}) THEN 0.0 "
            f"WHEN {t} = 0 THEN 1.0 ELSE greatest(1 - {series}, 0.0) END")


def z_of(est: str, se: str) -> str:
    return (f"CASE WHEN {se} > 0 THEN {est} / {se} WHEN {se} = 0 AND {est} > 0 THEN 'inf'::DOUBLE "
            f"WHEN {se} = 0 AND {est} < 0 THEN '-inf'::DOUBLE END")


SIG = f"""sig AS (
  SELECT *, {p_of('z_score')} AS p_value
  FROM (SELECT *, {z_of('att_score', 'att_std_err')} AS z_score
        FROM (SELECT *, sqrt(att_variance) AS att_std_err FROM att)))"""

SIGNIF = """signif AS (SELECT * FROM sig WHERE p_value < 0.01)"""


def rnd(cols: dict[str, str]) -> str:
    """Select list with doubles rounded: {"name": "d" (double) | "k" (keep)}."""
    out = []
    for c, kind in cols.items():
        out.append(f"round({c}, {R6}) AS {c}" if kind == "d" else c)
    return ", ".join(out)


def chain(src: str, p: str) -> list[str]:
    """C1-C9 over feature rows ``src`` with CTE names prefixed by ``p``."""
    ctes = []
    for frag in (CEM, BASE, TREAT, EFF, ATT, SIG):
        f = frag
        for name in ("cem", "base", "treat", "eff", "att", "sig"):
            f = f.replace(f"{name} AS (", f"{p}{name} AS (", 1) if f.startswith(f"{name} AS (") else f
            f = f.replace(f"FROM {name} ", f"FROM {p}{name} ").replace(f"FROM {name})", f"FROM {p}{name})")
            f = f.replace(f"FROM {name}\n", f"FROM {p}{name}\n")
        f = f.replace(f"FROM {p}feat", f"FROM {src}").replace("FROM feat", f"FROM {src}")
        f = f.replace("JOIN base b", f"JOIN {p}base b")
        ctes.append(f)
    return ctes


CORE = [SUBS, CLEAN.format(lo=800), META, FEAT]
CEM_CHAIN = CORE + [CEM]
ATT_CHAIN = CEM_CHAIN + [BASE, TREAT, EFF, ATT, SIG]

SUB_COLS = {"handle": "k", "time": "k", "id_of_submission_task": "k", "verdict": "k",
            "rating_at_submission": "d", "problem_rating": "d"}
META_COLS = {"id_of_submission_task": "k", "avg_provided_rating": "d", "avg_solver_rating": "d",
             "total_submissions": "k", "ok_count": "k", "has_sufficient_support": "k",
             "estimated_difficulty": "d", "acceptance_rate": "d", "stable_acceptance": "k"}
FEAT_COLS = {**SUB_COLS, "estimated_difficulty": "d", "roll_acc_20": "d", "roll_solve_cnt_20": "k",
             "time_since_last_sub": "k", "roll_sub_cnt_20": "k", "roll_ok_diff_20": "d",
             "roll_rating_delta_20": "d"}
EFF_COLS = {"id_of_submission_task": "k", "bin_rating": "k", "bin_acc": "k", "bin_diff": "k",
            "treated_gain": "d", "treated_std": "d", "treated_count": "k", "treated_improve_prob": "d",
            "baseline_gain": "d", "baseline_std": "d", "baseline_count": "k",
            "baseline_improve_prob": "d", "uplift": "d", "bucket_variance": "d",
            "probability_uplift": "d", "total_treated_samples": "k", "weight": "d"}
ATT_COLS = {"id_of_submission_task": "k", "att_score": "d", "att_variance": "d",
            "total_treated_samples": "k", "avg_rating_level": "d", "att_probability_uplift": "d"}
SIG_COLS = {**ATT_COLS, "att_std_err": "d", "z_score": "d", "p_value": "d"}

# ---------------------------------------------------------------- survival
SROWS = """srows AS (
  SELECT *, CAST(rating_at_submission >= rating_at_solve + 50 AS INTEGER) AS improved_event
  FROM (
    SELECT *, CAST(verdict = 'OK' AS INTEGER) AS is_solve,
           last_value(CASE WHEN verdict = 'OK' THEN rating_at_submission END IGNORE NULLS)
             OVER (PARTITION BY handle ORDER BY time, id_of_submission_task NULLS FIRST, verdict NULLS FIRST, rating_at_submission NULLS FIRST, problem_rating NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
             AS rating_at_solve,
           CAST(row_number() OVER (PARTITION BY handle ORDER BY time, id_of_submission_task NULLS FIRST, verdict NULLS FIRST, rating_at_submission NULLS FIRST, problem_rating NULLS FIRST) - 1 AS BIGINT) AS submission_idx
    FROM feat)
  WHERE rating_at_solve IS NOT NULL)"""

SPAIRS = """spairs AS (
  SELECT *, event_time - solve_time AS time_to_event,
         CAST(event_time IS NOT NULL AS INTEGER) AS event_observed
  FROM (
    SELECT handle, id_of_submission_task,
           min(CASE WHEN is_solve = 1 THEN submission_idx END) AS solve_time,
           min(CASE WHEN improved_event = 1 THEN submission_idx END) AS event_time
    FROM srows GROUP BY handle, id_of_submission_task)
  WHERE solve_time IS NOT NULL
    AND (event_time - solve_time >= 0 OR event_time IS NULL))"""

SURV = """surv0 AS (
  SELECT id_of_submission_task, avg(event_observed) AS event_rate,
         median(time_to_event) AS median_time_to_improve, count(*) AS sample_size
  FROM spairs GROUP BY id_of_submission_task HAVING count(*) >= 20),
surv AS (
  SELECT *, coalesce(CASE WHEN (SELECT avg(event_rate) FROM surv0) = 0 THEN NULL
                          ELSE event_rate / (SELECT avg(event_rate) FROM surv0) END, 1.0) AS hazard_ratio
  FROM surv0)"""

# T8 by brute force: for each first solve, the first later row reaching the solve rating + 50
TTI = """trows AS (
  SELECT handle, id_of_submission_task, verdict, rating_at_submission,
         CAST(row_number() OVER (PARTITION BY handle ORDER BY time, id_of_submission_task NULLS FIRST, verdict NULLS FIRST, rating_at_submission NULLS FIRST, problem_rating NULLS FIRST) - 1 AS BIGINT) AS idx FROM feat),
tq AS (SELECT handle, id_of_submission_task, min(idx) AS solve_idx,
              arg_min(rating_at_submission, idx) AS solve_rating
       FROM trows WHERE verdict = 'OK' GROUP BY ALL),
tti AS (
  SELECT q.*, (SELECT min(r.idx) FROM trows r WHERE r.handle = q.handle AND r.idx > q.solve_idx
                 AND r.rating_at_submission >= q.solve_rating + 50) AS event_idx,
         (SELECT max(r.idx) FROM trows r WHERE r.handle = q.handle) AS last_idx
  FROM tq q)"""

# ---------------------------------------------------------------- graph and paths
SOL = """sol AS (SELECT handle, time, id_of_submission_task AS pid, rating_at_submission, problem_rating FROM feat WHERE verdict = 'OK')"""

GRAPH = """graph AS (
  SELECT *, transition_count / sum(transition_count) OVER (PARTITION BY source_problem)
            AS transition_probability
  FROM (
    SELECT source_problem, target_problem, count(*) AS transition_count, avg(gap_size) AS avg_gap,
           count(DISTINCT handle) AS distinct_users
    FROM (
      SELECT handle, pid AS source_problem, lead(pid, 1) OVER w AS target_problem, 1 AS gap_size FROM sol WINDOW w AS (PARTITION BY handle ORDER BY time, pid NULLS FIRST, rating_at_submission NULLS FIRST, problem_rating NULLS FIRST)
      UNION ALL SELECT handle, pid, lead(pid, 2) OVER w, 2 FROM sol WINDOW w AS (PARTITION BY handle ORDER BY time, pid NULLS FIRST, rating_at_submission NULLS FIRST, problem_rating NULLS FIRST)
      UNION ALL SELECT handle, pid, lead(pid, 3) OVER w, 3 FROM sol WINDOW w AS (PARTITION BY handle ORDER BY time, pid NULLS FIRST, rating_at_submission NULLS FIRST, problem_rating NULLS FIRST)
      UNION ALL SELECT handle, pid, lead(pid, 4) OVER w, 4 FROM sol WINDOW w AS (PARTITION BY handle ORDER BY time, pid NULLS FIRST, rating_at_submission NULLS FIRST, problem_rating NULLS FIRST)
      UNION ALL SELECT handle, pid, lead(pid, 5) OVER w, 5 FROM sol WINDOW w AS (PARTITION BY handle ORDER BY time, pid NULLS FIRST, rating_at_submission NULLS FIRST, problem_rating NULLS FIRST))
    WHERE target_problem IS NOT NULL
    GROUP BY source_problem, target_problem
    HAVING count(*) >= 10))"""

IPTS = """ipts AS (
  SELECT *, CASE WHEN count(d) OVER t = 20 THEN sum(d) OVER t END >= 100 AS improved
  FROM (SELECT *, rating_at_submission - lag(rating_at_submission) OVER (PARTITION BY handle ORDER BY time, id_of_submission_task NULLS FIRST, verdict NULLS FIRST, rating_at_submission NULLS FIRST, problem_rating NULLS FIRST) AS d
        FROM feat)
  WINDOW t AS (PARTITION BY handle ORDER BY time, id_of_submission_task NULLS FIRST, verdict NULLS FIRST, rating_at_submission NULLS FIRST, problem_rating NULLS FIRST ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""

# brute force: every (point, earlier solve) pair, keep the 3 latest
PATHS = """paths AS (
  SELECT id_of_submission_task, support, support / max(support) OVER () AS sequence_confidence
  FROM (
    SELECT pid AS id_of_submission_task, count(*) AS support
    FROM (
      SELECT s.pid, row_number() OVER (PARTITION BY p.handle, p.time ORDER BY s.time DESC, s.pid DESC NULLS LAST,
             s.rating_at_submission DESC, s.problem_rating DESC NULLS LAST) AS rk
      FROM ipts p JOIN sol s ON s.handle = p.handle AND s.time < p.time
      WHERE p.improved)
    WHERE rk <= 3
    GROUP BY pid HAVING count(*) >= 30))"""

# ---------------------------------------------------------------- placebo


def bias_sql(src: str, extra: str, name: str) -> str:
    k = f"{extra}, " if extra else ""
    on = f"t.{extra} = b.{extra} AND " if extra else ""
    return f"""{name} AS (
  WITH pb AS (
    SELECT {k}CAST(round(rating_at_submission / 100) AS INTEGER) AS bin_rating,
           CAST(round(roll_acc_20 * 10) AS INTEGER) AS bin_acc,
           CAST(round(roll_ok_diff_20 / 200) AS INTEGER) AS bin_diff,
           id_of_submission_task, placebo_gain, CAST(placebo_gain > 0 AS INTEGER) AS placebo_improved
    FROM {src} WHERE placebo_gain IS NOT NULL),
  b AS (SELECT {k}bin_rating, bin_acc, bin_diff, avg(placebo_gain) AS bg, avg(placebo_improved) AS bp,
               count(placebo_gain) AS bn
        FROM pb GROUP BY ALL HAVING count(placebo_gain) >= 20),
  t AS (SELECT {k}id_of_submission_task, bin_rating, bin_acc, bin_diff, avg(placebo_gain) AS tg,
               count(placebo_gain) AS tn, avg(placebo_improved) AS tp
        FROM pb GROUP BY ALL HAVING count(placebo_gain) >= 20),
  j AS (SELECT t.*, tg - bg AS sb, tp - bp AS psb FROM t JOIN b
          ON {on}t.bin_rating = b.bin_rating AND t.bin_acc = b.bin_acc AND t.bin_diff = b.bin_diff
        WHERE abs(tg - bg) <= 300)
  SELECT {k}id_of_submission_task, sum(sb * tn) / sum(tn) AS bias_score,
         sum(psb * tn) / sum(tn) AS probability_bias_score, CAST(sum(tn) AS BIGINT) AS total_samples
  FROM j GROUP BY ALL)"""


PLACEBO_SRC = """plsrc AS (
  SELECT *, rating_at_submission - lag(rating_at_submission, 20) OVER (PARTITION BY handle ORDER BY time, id_of_submission_task NULLS FIRST, verdict NULLS FIRST, rating_at_submission NULLS FIRST, problem_rating NULLS FIRST)
            AS placebo_gain FROM feat)"""

PRETREND_SRC = """ptsrc AS (
  SELECT *, unnest([5, 10, 15, 20]) AS lag,
         unnest([rating_at_submission - lag(rating_at_submission, 5) OVER w,
                 rating_at_submission - lag(rating_at_submission, 10) OVER w,
                 rating_at_submission - lag(rating_at_submission, 15) OVER w,
                 rating_at_submission - lag(rating_at_submission, 20) OVER w]) AS placebo_gain
  FROM feat WINDOW w AS (PARTITION BY handle ORDER BY time, id_of_submission_task NULLS FIRST, verdict NULLS FIRST, rating_at_submission NULLS FIRST, problem_rating NULLS FIRST))"""

RFEAT = """rfeat AS (
  SELECT * REPLACE ('R' || CAST(
      CAST(('0x' || substr(md5(handle || ':' || CAST(time AS VARCHAR)), 1, 8)) AS BIGINT)
      % (SELECT count(*) FROM meta) AS VARCHAR) AS id_of_submission_task)
  FROM feat)"""

# ---------------------------------------------------------------- recommender


def cat_sql(name: str, src: str) -> str:
    return f"""{name} AS (
  SELECT *, CASE WHEN isnan(s0) THEN NULL ELSE s0 END AS final_score FROM (
    SELECT e.*, sv.median_time_to_improve, coalesce(sv.hazard_ratio, 1.0) AS hazard_ratio,
           coalesce(ps.sequence_confidence, 0.0) AS sequence_confidence,
           m.estimated_difficulty, m.acceptance_rate,
           e.att_score * e.att_probability_uplift * coalesce(sv.hazard_ratio, 1.0)
             * (1 + coalesce(ps.sequence_confidence, 0.0)) AS s0
    FROM {src} e LEFT JOIN surv sv USING (id_of_submission_task)
                 LEFT JOIN paths ps USING (id_of_submission_task)
                 LEFT JOIN meta m USING (id_of_submission_task)))"""


PROF = """prof AS (
  SELECT handle, CAST(trunc(r) AS INTEGER) AS current_rating, 'local_user' AS rank,
         round_even(coalesce(a, 0.5), 2) AS recent_accuracy, round_even(coalesce(d, r), 1) AS recent_avg_difficulty
  FROM (SELECT handle, arg_max(rating_at_submission, time) AS r, arg_max(roll_acc_20, time) AS a,
               arg_max(roll_ok_diff_20, time) AS d FROM feat GROUP BY handle))"""


def recs_sql(cat: str, name: str) -> str:
    return f"""{name} AS (
  WITH ratings AS (SELECT DISTINCT current_rating FROM prof),
  inb AS (SELECT r.current_rating, c.* FROM ratings r JOIN {cat} c
            ON c.estimated_difficulty BETWEEN r.current_rating - 200 AND r.current_rating + 400),
  fb AS (SELECT r.current_rating, c.* FROM ratings r, {cat} c
         WHERE r.current_rating NOT IN (SELECT current_rating FROM inb)),
  ranked AS (
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY current_rating
                    ORDER BY final_score DESC NULLS LAST, id_of_submission_task) AS INTEGER) AS rec_rank,
                   TRUE AS in_band FROM inb) WHERE rec_rank <= 5
    UNION ALL
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY current_rating
                    ORDER BY final_score DESC NULLS LAST, id_of_submission_task) AS INTEGER) AS rec_rank,
                   FALSE AS in_band FROM fb) WHERE rec_rank <= 5)
  SELECT p.handle, p.current_rating, k.rec_rank, k.in_band, k.id_of_submission_task AS problem_id,
         k.att_score AS uplift, k.att_probability_uplift AS probability_uplift, k.p_value, k.hazard_ratio,
         coalesce(CAST(k.median_time_to_improve AS DOUBLE), -1.0) AS median_time_to_improve,
         k.estimated_difficulty,
         printf('Highly recommended (Score: %.1f). Causal Uplift: +%.1f points (p=%.4f). Solvers improve %.1fx faster.',
                k.final_score, k.att_score, k.p_value, k.hazard_ratio) AS explanation,
         k.total_treated_samples AS sample_size, k.final_score,
         CASE WHEN k.id_of_submission_task IS NULL THEN 'no_match' ELSE 'success' END AS status
  FROM prof p LEFT JOIN ranked k USING (current_rating))"""


REC_COLS = {"handle": "k", "current_rating": "k", "rec_rank": "k", "in_band": "k", "problem_id": "k",
            "uplift": "d", "probability_uplift": "d", "p_value": "d", "hazard_ratio": "d",
            "median_time_to_improve": "d", "estimated_difficulty": "d", "explanation": "k",
            "sample_size": "k", "final_score": "d", "status": "k"}
CAT_COLS = {**SIG_COLS, "median_time_to_improve": "d", "hazard_ratio": "d", "sequence_confidence": "d",
            "estimated_difficulty": "d", "acceptance_rate": "d", "final_score": "d"}

FULL = ATT_CHAIN + [SROWS, SPAIRS, SURV, SOL, IPTS, PATHS]


def dtier(c: str) -> str:
    return f"CASE WHEN {c} <= 1400 THEN 'easy' WHEN {c} <= 1700 THEN 'medium' ELSE 'hard' END"


# titles and tags of the problems: part k belongs to problem k % 10
DIM = """dim AS (
  WITH p AS (SELECT 'P' || lpad(CAST(p_partkey % 10 AS VARCHAR), 2, '0') AS pid, p_partkey, p_name, p_type FROM part),
  w AS (SELECT pid, unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS tag FROM p),
  c AS (SELECT pid, tag, row_number() OVER (PARTITION BY pid ORDER BY count(*) DESC, tag) AS r
        FROM w WHERE tag <> '' GROUP BY pid, tag)
  SELECT t.pid AS id_of_submission_task, t.title, l.tags
  FROM (SELECT pid, arg_min(p_name, p_partkey) AS title FROM p GROUP BY pid) t
  JOIN (SELECT pid, list(tag ORDER BY r) AS tags FROM c WHERE r <= 3 GROUP BY pid) l USING (pid))"""

# lineitem -> submissions: handle = supplier, problem = brand, thresholds of the reference
LI_SUBS = """subs AS (
  WITH d AS (
    SELECT CAST(l_suppkey AS VARCHAR) AS handle, epoch_us(CAST(l_shipdate AS TIMESTAMP)) AS time, l_orderkey, l_linenumber,
           l_partkey, l_extendedprice, coalesce(p_brand, 'Brand#00') AS id_of_submission_task,
           CASE WHEN l_returnflag = 'R' THEN 'WRONG_ANSWER' ELSE 'OK' END AS verdict,
           CAST(round(l_discount * 100) AS INTEGER) - 5 + CASE p_brand WHEN 'Brand#11' THEN 15 WHEN 'Brand#12' THEN 8
             WHEN 'Brand#54' THEN -8 WHEN 'Brand#55' THEN -15 ELSE 0 END AS step,
           CASE WHEN p_brand = 'Brand#33' THEN NULL
                ELSE CAST(800 + 40 * CAST(regexp_extract(p_brand, '#(\\d+)', 1) AS INTEGER) AS DOUBLE) END AS problem_rating
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey)
  SELECT * EXCLUDE (step), CAST(1500 + coalesce(sum(step) OVER (PARTITION BY handle
           ORDER BY time, l_orderkey, l_linenumber, l_partkey, l_extendedprice
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS rating_at_submission
  FROM d)"""
LI_ORDER = "time, l_orderkey, l_linenumber, l_partkey, l_extendedprice"


def _li(fragment: str) -> str:
    """A fragment over the lineitem log: its order of a history and the reference's minimums."""
    if fragment == SUBS:
        return LI_SUBS
    f = fragment
    for name in ("id_of_submission_task NULLS FIRST, verdict NULLS FIRST", "pid NULLS FIRST"):
        f = f.replace(f"time, {name}, rating_at_submission NULLS FIRST, problem_rating NULLS FIRST", LI_ORDER)
    f = f.replace("s.time DESC, s.pid DESC NULLS LAST,\n             s.rating_at_submission DESC, s.problem_rating DESC NULLS LAST",
                  ", ".join(f"s.{c} DESC" for c in LI_ORDER.split(", ")))
    own = "l_orderkey, l_linenumber, l_partkey, l_extendedprice, "
    if fragment == FEAT:
        f = f.replace("  SELECT handle, time, id_of_submission_task, verdict", f"  SELECT {own}handle, time, id_of_submission_task, verdict")
    if fragment == SOL:
        f = f.replace("SELECT handle, time,", f"SELECT {own}handle, time,")
    if fragment == PROF:
        for c in ("rating_at_submission", "roll_acc_20", "roll_ok_diff_20"):
            f = f.replace(f"arg_max({c}, time)", f"last({c} ORDER BY {LI_ORDER})")
    if fragment == BASE:
        f = f.replace(f">= {MS})", ">= 50)")
    if fragment == TREAT:
        f = f.replace(f">= {MT})", ">= 10)")
    if fragment == EFF:
        f = f.replace(f"treated_count >= {MS} AND baseline_count >= {MS}", "treated_count >= 50 AND baseline_count >= 50")
    return f


# Discriminant scores per problem from the rows themselves, five strata of treated rows
def _cov(i: str, k: str, ridge: str) -> str:
    own = f"t{i}{k} - t{i} * t{k} / t + c{i}{k} - c{i} * c{k} / c"
    return f"(({own}) / greatest(t + c - 2, 1) + {ridge}) AS s{i}{k}"


PROP = """pc AS (
  SELECT id_of_submission_task AS pid, bin_rating AS x0, bin_acc AS x1, bin_diff AS x2, count(*) AS t_n
  FROM cem WHERE bin_rating IS NOT NULL AND bin_acc IS NOT NULL AND bin_diff IS NOT NULL GROUP BY ALL),
pa AS (SELECT x0, x1, x2, sum(t_n) AS a_n FROM pc GROUP BY ALL),
pm AS (SELECT pc.*, CAST(a_n - t_n AS BIGINT) AS c_n FROM pc JOIN pa USING (x0, x1, x2) WHERE a_n > t_n),
ps AS (SELECT pid, """ + ", ".join(
    f"CAST(sum({s}_n) AS DOUBLE) AS {s}, " + ", ".join(f"CAST(sum({s}_n * x{i}) AS DOUBLE) AS {s}{i}" for i in range(3)) + ", "
    + ", ".join(f"CAST(sum({s}_n * x{i} * x{k}) AS DOUBLE) AS {s}{i}{k}" for i in range(3) for k in range(i, 3)) for s in "tc") + """
  FROM pm GROUP BY pid),
pv AS (SELECT pid, t0 / t - c0 / c AS d0, t1 / t - c1 / c AS d1, t2 / t - c2 / c AS d2, """ + ", ".join(
    _cov(str(i), str(k), "1e-6" if i == k else "0") for i in range(3) for k in range(i, 3)) + """ FROM ps),
pd AS (SELECT *, s00 * (s11 * s22 - s12 * s12) - s01 * (s01 * s22 - s12 * s02) + s02 * (s01 * s12 - s11 * s02) AS det FROM pv),
pw AS (SELECT pid,
         ((s11 * s22 - s12 * s12) * d0 + (s02 * s12 - s01 * s22) * d1 + (s01 * s12 - s02 * s11) * d2) / det AS w0,
         ((s02 * s12 - s01 * s22) * d0 + (s00 * s22 - s02 * s02) * d1 + (s01 * s02 - s00 * s12) * d2) / det AS w1,
         ((s01 * s12 - s02 * s11) * d0 + (s01 * s02 - s00 * s12) * d1 + (s00 * s11 - s01 * s01) * d2) / det AS w2
       FROM pd WHERE det <> 0),
pq AS (SELECT pm.*, round(w0 * x0 + w1 * x1 + w2 * x2, 9) AS score FROM pm JOIN pw USING (pid)),
pk AS (SELECT *, CAST(least(4, floor(5 * (sum(t_n) OVER (PARTITION BY pid ORDER BY score, x0, x1, x2
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - t_n / 2) / sum(t_n) OVER (PARTITION BY pid))) AS INTEGER) AS stratum
       FROM pq),
pr AS (SELECT pk.pid, pk.stratum, pk.score, r.id_of_submission_task = pk.pid AS own, r.rating_gain_20 AS g, r.improved_20 AS i
       FROM pk JOIN cem r ON r.bin_rating = pk.x0 AND r.bin_acc = pk.x1 AND r.bin_diff = pk.x2),
pstr AS (
  SELECT pid AS id_of_submission_task, stratum, count(*) FILTER (WHERE own) AS treated, count(*) FILTER (WHERE NOT own) AS controls,
         avg(g) FILTER (WHERE own) AS treated_gain, avg(g) FILTER (WHERE NOT own) AS control_gain,
         avg(g) FILTER (WHERE own) - avg(g) FILTER (WHERE NOT own) AS uplift,
         var_samp(g) FILTER (WHERE own) / count(*) FILTER (WHERE own)
           + var_samp(g) FILTER (WHERE NOT own) / count(*) FILTER (WHERE NOT own) AS variance,
         avg(i) FILTER (WHERE own) - avg(i) FILTER (WHERE NOT own) AS probability_uplift,
         min(score) AS low_score, max(score) AS high_score
  FROM pr GROUP BY pid, stratum)"""


def _positive_zero(sql: str) -> str:
    """Wrap every ``round(<expr>, 6)`` as ``(round(<expr>, 6) + 0.0)``: DuckDB
    rounds tiny negatives to -0.0, Spark to 0.0."""
    out, i, key = [], 0, "round("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out.append(sql[i:j + len(key)])
            i = j + len(key)
            continue
        depth, k = 1, j + len(key)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = sql[j + len(key):k - 1]
        body = _positive_zero(inner)
        call = f"round({body})"
        out.append(sql[i:j])
        out.append(f"({call} + 0.0)" if inner.rstrip().endswith(f", {R6}") else call)
        i = k


def queries() -> dict[str, str]:
    return {k: _positive_zero(v) for k, v in _queries().items()}


def _queries() -> dict[str, str]:
    q = {}
    q["clean_submissions"] = (with_(SUBS, CLEAN.format(lo=800))
                              + f"SELECT {rnd(SUB_COLS)} FROM clean")
    cols = ["handle", "time", "id_of_submission_task", "verdict", "rating_at_submission", "problem_rating"]
    q["profile_submissions"] = with_(*CORE[:2]) + " UNION ALL ".join(
        f"SELECT (SELECT count(*) FROM clean) AS n_rows, '{c}' AS column_name, {i} AS position, "
        f"count(*) FILTER (WHERE {c} IS NULL) AS null_count, CAST(min({c}) AS VARCHAR) AS min_value, "
        f"CAST(max({c}) AS VARCHAR) AS max_value FROM clean" for i, c in enumerate(cols))
    q["problem_metadata"] = with_(*CORE[:3]) + f"SELECT {rnd(META_COLS)} FROM meta"
    q["metadata_summary"] = (with_(*CORE[:3]) + "SELECT count(*) AS total_problems, "
                             "count(*) FILTER (WHERE has_sufficient_support) AS supported_problems, "
                             "count(*) FILTER (WHERE stable_acceptance) AS stable_acceptance_problems FROM meta")
    q["user_features"] = with_(*CORE) + f"SELECT {rnd(FEAT_COLS)} FROM feat"
    q["outcome_gain"] = (with_(*CEM_CHAIN) + "SELECT handle, time, id_of_submission_task, "
                         "round(future_rating_20, 6) AS future_rating_20, "
                         "round(rating_gain_20, 6) AS rating_gain_20, improved_20 FROM cem")
    q["state_bins"] = (with_(*CEM_CHAIN) + "SELECT bin_rating, bin_acc, bin_diff, count(*) AS n_rows, "
                       "round(avg(rating_gain_20), 6) AS mean_gain FROM cem GROUP BY ALL")
    q["cem_baseline"] = (with_(*CEM_CHAIN, BASE) + "SELECT bin_rating, bin_acc, bin_diff, "
                         "round(baseline_gain, 6) AS baseline_gain, round(baseline_std, 6) AS baseline_std, "
                         "baseline_count, round(baseline_improve_prob, 6) AS baseline_improve_prob FROM base")
    q["cem_treated"] = (with_(*CEM_CHAIN, TREAT) + "SELECT id_of_submission_task, bin_rating, bin_acc, bin_diff, "
                        "round(treated_gain, 6) AS treated_gain, round(treated_std, 6) AS treated_std, "
                        "treated_count, round(treated_improve_prob, 6) AS treated_improve_prob FROM treat")
    ec = rnd(EFF_COLS).replace("total_treated_samples,", "CAST(total_treated_samples AS BIGINT) AS total_treated_samples,")
    q["cem_effects"] = with_(*ATT_CHAIN) + f"SELECT {ec} FROM eff"
    fix = lambda s: s.replace("total_treated_samples,", "CAST(total_treated_samples AS BIGINT) AS total_treated_samples,")
    q["att_effects"] = with_(*ATT_CHAIN) + f"SELECT {fix(rnd(ATT_COLS))} FROM att"
    q["att_significance"] = with_(*ATT_CHAIN) + f"SELECT {fix(rnd(SIG_COLS))} FROM sig"
    q["att_significant"] = with_(*ATT_CHAIN, SIGNIF) + f"SELECT {fix(rnd(SIG_COLS))} FROM signif"
    q["cohort_examples"] = with_(*ATT_CHAIN, SIGNIF) + """
      SELECT handle, id_of_submission_task, round(rating_at_submission, 6) AS rating_before,
             round(future_rating_20, 6) AS rating_after, round(rating_gain_20, 6) AS rating_gain
      FROM (SELECT *, row_number() OVER (PARTITION BY id_of_submission_task
                                         ORDER BY rating_gain_20 DESC, handle, time) AS rn
            FROM cem WHERE rating_gain_20 > 0
              AND id_of_submission_task IN (SELECT id_of_submission_task FROM signif))
      WHERE rn <= 5"""
    q["att_detailed"] = (with_(*ATT_CHAIN, SIGNIF) + f"SELECT {ec} FROM eff WHERE id_of_submission_task IN "
                         "(SELECT id_of_submission_task FROM signif)")
    # X2 X3 X4 X13
    q["att_bonferroni"] = with_(*ATT_CHAIN) + """
      SELECT id_of_submission_task, round(att_score, 6) AS att_score, round(p_value, 6) AS p_value, n_tests,
             round(least(1.0, p_value * n_tests), 6) AS p_bonferroni,
             least(1.0, p_value * n_tests) < 0.01 AS significant_bonferroni
      FROM sig, (SELECT count(p_value) AS n_tests FROM sig)"""
    q["att_cohens_d"] = with_(*ATT_CHAIN) + """
      SELECT id_of_submission_task, round(sum(weight * d), 6) AS cohens_d,
             CAST(sum(treated_count) AS BIGINT) AS treated_samples
      FROM (SELECT *, CASE WHEN pooled > 0 THEN uplift / pooled END AS d
            FROM (SELECT *, sqrt(((treated_count - 1) * treated_std ^ 2 + (baseline_count - 1) * baseline_std ^ 2)
                                 / (treated_count + baseline_count - 2)) AS pooled FROM eff))
      GROUP BY id_of_submission_task"""
    q["welch_stats"] = with_(*ATT_CHAIN) + f"""
      SELECT id_of_submission_task, round(att_score, 6) AS att_score, round(t_stat, 6) AS t_stat,
             round(CASE WHEN den = 0 THEN NULL ELSE att_variance ^ 2 / den END, 6) AS welch_df,
             round({p_of('t_stat')}, 6) AS p_value,
             round({t_p_of('t_stat', '(CASE WHEN den = 0 THEN NULL ELSE att_variance ^ 2 / den END)')}, 6) AS p_value_t
      FROM (SELECT *, {z_of('att_score', 'sqrt(att_variance)')} AS t_stat
            FROM (SELECT id_of_submission_task, sum(weight * uplift) AS att_score, sum(a + b) AS att_variance,
                         sum(a ^ 2 / (treated_count - 1) + b ^ 2 / (baseline_count - 1)) AS den
                  FROM (SELECT *, weight ^ 2 * treated_std ^ 2 / treated_count AS a,
                               weight ^ 2 * baseline_std ^ 2 / baseline_count AS b FROM eff)
                  GROUP BY id_of_submission_task))"""
    q["att_intervals"] = with_(*ATT_CHAIN) + """
      SELECT id_of_submission_task, round(att_score, 6) AS att_score, round(att_std_err, 6) AS att_std_err,
             round(att_score - 2.5758293035489004 * att_std_err, 6) AS ci_low,
             round(att_score + 2.5758293035489004 * att_std_err, 6) AS ci_high
      FROM sig"""
    q["balance_check"] = with_(*ATT_CHAIN) + """,
      lng AS (SELECT id_of_submission_task, bin_rating, bin_acc, bin_diff, 'rating' AS covariate,
                     rating_at_submission AS x FROM cem
              UNION ALL SELECT id_of_submission_task, bin_rating, bin_acc, bin_diff, 'accuracy', roll_acc_20 FROM cem
              UNION ALL SELECT id_of_submission_task, bin_rating, bin_acc, bin_diff, 'difficulty', roll_ok_diff_20 FROM cem),
      c AS (SELECT bin_rating, bin_acc, bin_diff, covariate, avg(x) AS m, var_pop(x) AS v FROM lng GROUP BY ALL),
      t AS (SELECT l.id_of_submission_task, l.covariate, avg(x) AS mt, var_samp(x) AS vt
            FROM lng l JOIN eff e USING (id_of_submission_task, bin_rating, bin_acc, bin_diff) GROUP BY ALL),
      k AS (SELECT e.id_of_submission_task, c.covariate, e.weight AS w, c.m, c.v
            FROM eff e JOIN c USING (bin_rating, bin_acc, bin_diff)),
      mc AS (SELECT id_of_submission_task, covariate, sum(w * m) AS mc FROM k GROUP BY ALL),
      vc AS (SELECT k.id_of_submission_task, k.covariate, sum(w * (v + (m - mc) ^ 2)) AS vc
             FROM k JOIN mc USING (id_of_submission_task, covariate) GROUP BY ALL)
      SELECT id_of_submission_task, covariate, round(mt, 6) AS treated_mean, round(mc, 6) AS control_mean,
             round(CASE WHEN (vt + vc) / 2 > 0 THEN (mt - mc) / sqrt((vt + vc) / 2) END, 6) AS smd
      FROM t JOIN mc USING (id_of_submission_task, covariate) JOIN vc USING (id_of_submission_task, covariate)"""
    q["att_effects_solvers"] = with_(*CEM_CHAIN) + f""",
      s AS (SELECT id_of_submission_task, bin_rating, bin_acc, bin_diff, count(rating_gain_20) AS t_n,
                   avg(rating_gain_20) AS t_m, var_samp(rating_gain_20) AS t_v, avg(improved_20) AS t_p
            FROM cem WHERE verdict = 'OK' GROUP BY ALL),
      j AS (SELECT s.*, count(*) AS c_n, avg(r.rating_gain_20) AS c_m, var_samp(r.rating_gain_20) AS c_v,
                   avg(r.improved_20) AS c_p
            FROM s JOIN cem r ON s.bin_rating = r.bin_rating AND s.bin_acc = r.bin_acc AND s.bin_diff = r.bin_diff
                 AND NOT (r.id_of_submission_task = s.id_of_submission_task AND r.verdict = 'OK')
            GROUP BY ALL),
      k AS (SELECT *, t_m - c_m AS uplift, t_v / t_n + c_v / c_n AS bucket_variance, t_p - c_p AS probability_uplift
            FROM j WHERE t_n >= {MS} AND c_n >= {MS}),
      w AS (SELECT *, t_n / sum(t_n) OVER (PARTITION BY id_of_submission_task) AS weight,
                   sum(t_n) OVER (PARTITION BY id_of_submission_task) AS tot
            FROM k WHERE abs(uplift) <= 300),
      att AS (SELECT id_of_submission_task, sum(weight * uplift) AS att_score,
                     sum(weight ^ 2 * bucket_variance) AS att_variance, CAST(max(tot) AS BIGINT) AS total_treated_samples,
                     sum(probability_uplift * t_n) / sum(t_n) AS att_probability_uplift
              FROM w GROUP BY ALL),
      sig AS (SELECT *, {p_of('z_score')} AS p_value
              FROM (SELECT *, {z_of('att_score', 'att_std_err')} AS z_score
                    FROM (SELECT *, sqrt(att_variance) AS att_std_err FROM att)))
      SELECT id_of_submission_task, round(att_score, 6) AS att_score, round(att_variance, 6) AS att_variance,
             total_treated_samples, round(att_probability_uplift, 6) AS att_probability_uplift,
             round(att_std_err, 6) AS att_std_err, round(z_score, 6) AS z_score, round(p_value, 6) AS p_value
      FROM sig"""
    q["propensity_strata"] = with_(*CEM_CHAIN, PROP) + """
      SELECT id_of_submission_task, stratum, treated, controls, round(treated_gain, 6) AS treated_gain,
             round(control_gain, 6) AS control_gain, round(uplift, 6) AS uplift, round(variance, 6) AS variance,
             round(probability_uplift, 6) AS probability_uplift, round(low_score, 6) AS low_score,
             round(high_score, 6) AS high_score FROM pstr"""
    q["propensity_effects"] = with_(*CEM_CHAIN, PROP) + f""",
      att AS (SELECT id_of_submission_task, sum(treated * uplift) / sum(treated) AS att_score,
                     sum(treated * treated * variance) / (sum(treated) * sum(treated)) AS att_variance,
                     CAST(sum(treated) AS BIGINT) AS total_treated_samples, count(*) AS strata,
                     sum(treated * probability_uplift) / sum(treated) AS att_probability_uplift
              FROM pstr WHERE treated >= {MS} AND controls >= {MS} GROUP BY ALL),
      sig AS (SELECT *, {p_of('z_score')} AS p_value
              FROM (SELECT *, {z_of('att_score', 'att_std_err')} AS z_score
                    FROM (SELECT *, sqrt(att_variance) AS att_std_err FROM att)))
      SELECT id_of_submission_task, round(att_score, 6) AS att_score, round(att_variance, 6) AS att_variance, total_treated_samples,
             strata, round(att_probability_uplift, 6) AS att_probability_uplift, round(att_std_err, 6) AS att_std_err,
             round(z_score, 6) AS z_score, round(p_value, 6) AS p_value FROM sig"""
    # T
    q["survival_rows"] = with_(*CORE, SROWS) + """
      SELECT handle, time, id_of_submission_task, is_solve, round(rating_at_solve, 6) AS rating_at_solve,
             submission_idx, improved_event FROM srows"""
    q["survival_pairs"] = with_(*CORE, SROWS, SPAIRS) + "SELECT * FROM spairs"
    q["survival_effects"] = with_(*CORE, SROWS, SPAIRS, SURV) + """
      SELECT id_of_submission_task, round(event_rate, 6) AS event_rate,
             round(median_time_to_improve, 6) AS median_time_to_improve, sample_size,
             round(hazard_ratio, 6) AS hazard_ratio FROM surv"""
    q["time_quantiles"] = with_(*CORE, SROWS, SPAIRS) + """
      SELECT id_of_submission_task, round(quantile_cont(time_to_event, 0.5), 6) AS median_time,
             round(quantile_cont(time_to_event, 0.75), 6) AS p75_time, count(*) AS observed
      FROM spairs WHERE event_observed = 1 GROUP BY id_of_submission_task"""
    q["time_to_improve"] = with_(*CORE, TTI) + """
      SELECT handle, id_of_submission_task, solve_idx, round(solve_rating, 6) AS solve_rating, event_idx,
             event_idx - solve_idx AS time_to_improve, CAST(event_idx IS NOT NULL AS INTEGER) AS event_observed,
             CASE WHEN event_idx IS NOT NULL THEN event_idx - solve_idx ELSE last_idx - solve_idx END AS duration
      FROM tti"""
    q["kaplan_meier"] = with_(*CORE, TTI) + """,
      d AS (SELECT id_of_submission_task, CASE WHEN event_idx IS NOT NULL THEN event_idx - solve_idx
                                               ELSE last_idx - solve_idx END AS t,
                   CAST(event_idx IS NOT NULL AS INTEGER) AS e FROM tti),
      g AS (SELECT id_of_submission_task, t, CAST(sum(e) AS BIGINT) AS events,
                   CAST(sum(1 - e) AS BIGINT) AS censored FROM d GROUP BY ALL),
      r AS (SELECT *, CAST(sum(events + censored) OVER (PARTITION BY id_of_submission_task ORDER BY t
                      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS at_risk FROM g)
      SELECT id_of_submission_task, t AS time, at_risk, events, censored,
             round(CASE WHEN max(CASE WHEN events >= at_risk THEN 1 ELSE 0 END) OVER up = 1 THEN 0.0
                        ELSE exp(sum(CASE WHEN events < at_risk THEN ln(1 - events / at_risk) ELSE 0 END) OVER up)
                   END, 6) AS survival
      FROM r WINDOW up AS (PARTITION BY id_of_submission_task ORDER BY t
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
    # G P X9
    q["transition_graph"] = with_(*CORE, SOL, GRAPH) + """
      SELECT source_problem, target_problem, transition_count, round(avg_gap, 6) AS avg_gap,
             distinct_users, round(transition_probability, 6) AS transition_probability FROM graph"""
    q["improvement_points"] = with_(*CORE, IPTS) + """
      SELECT handle, time, id_of_submission_task, round(rating_at_submission, 6) AS rating_at_submission
      FROM ipts WHERE improved"""
    q["path_support"] = with_(*CORE, SOL, IPTS, PATHS) + """
      SELECT id_of_submission_task, support, round(sequence_confidence, 6) AS sequence_confidence FROM paths"""
    q["path_patterns"] = with_(*CORE, SOL) + """,
      tri AS (SELECT pid AS first, lead(pid, 1) OVER w AS second, lead(pid, 2) OVER w AS third
              FROM sol WINDOW w AS (PARTITION BY handle ORDER BY time, pid NULLS FIRST, rating_at_submission NULLS FIRST, problem_rating NULLS FIRST)),
      pr AS (SELECT first, second, count(*) AS pair_support FROM tri WHERE second IS NOT NULL GROUP BY ALL),
      tr AS (SELECT first, second, third, count(*) AS support FROM tri WHERE third IS NOT NULL
             GROUP BY ALL HAVING count(*) >= 5)
      SELECT first, second, third, first || '>' || second || '>' || third AS pattern, support,
             round(support / pair_support, 6) AS confidence
      FROM tr JOIN pr USING (first, second)"""
    q["gapped_patterns"] = with_(*CORE, SOL) + """,
      n AS (SELECT handle, pid, row_number() OVER (PARTITION BY handle ORDER BY time, pid NULLS FIRST, rating_at_submission NULLS FIRST, problem_rating NULLS FIRST) AS i FROM sol),
      one AS (SELECT pid AS pattern, count(DISTINCT handle) AS support FROM n GROUP BY pid),
      pairs AS (SELECT a.handle, a.pid AS p1, b.pid AS p2, b.i FROM n a JOIN n b
                  ON a.handle = b.handle AND b.i BETWEEN a.i + 1 AND a.i + 5),
      two AS (SELECT p1 || '>' || p2 AS pattern, p1 AS prefix, 2 AS length, count(DISTINCT handle) AS support
              FROM pairs GROUP BY p1, p2),
      three AS (SELECT p1 || '>' || p2 || '>' || c.pid AS pattern, p1 || '>' || p2 AS prefix, 3 AS length,
                       count(DISTINCT handle) AS support
                FROM pairs JOIN n c USING (handle) WHERE c.i BETWEEN pairs.i + 1 AND pairs.i + 5 GROUP BY p1, p2, c.pid)
      SELECT a.pattern, a.length, a.support, b.support AS prefix_support, round(a.support / b.support, 6) AS confidence
      FROM (SELECT * FROM two UNION ALL SELECT * FROM three) a
      JOIN (SELECT pattern, support FROM one UNION ALL SELECT pattern, support FROM two) b ON a.prefix = b.pattern
      WHERE a.support >= 5"""
    # V X6 X7
    q["placebo_bias"] = with_(*CORE, PLACEBO_SRC, bias_sql("plsrc", "", "pbias")) + """
      SELECT id_of_submission_task, round(bias_score, 6) AS bias_score,
             round(probability_bias_score, 6) AS probability_bias_score, total_samples FROM pbias"""
    q["placebo_summary"] = with_(*CORE, PLACEBO_SRC, bias_sql("plsrc", "", "pbias")) + """
      SELECT round(avg(bias_score), 6) AS mean_bias_score, count(*) AS problems FROM pbias"""
    q["pre_trend"] = with_(*CORE, PRETREND_SRC, bias_sql("ptsrc", "lag", "pt")) + """
      SELECT lag, id_of_submission_task, round(bias_score, 6) AS bias_score,
             round(probability_bias_score, 6) AS probability_bias_score, total_samples FROM pt"""
    q["random_placebo"] = with_(*CORE, RFEAT, *chain("rfeat", "r_")) + f"SELECT {fix(rnd(SIG_COLS))} FROM r_sig"
    # R U X10-X12
    rec_base = FULL + [cat_sql("cat_all", "sig"), SIGNIF, cat_sql("cat_sig", "signif"), PROF]
    q["recommender_catalog"] = with_(*rec_base) + f"SELECT {fix(rnd(CAT_COLS))} FROM cat_all"
    q["user_profiles"] = with_(*CORE, PROF) + """
      SELECT handle, current_rating, rank, round(recent_accuracy, 6) AS recent_accuracy,
             round(recent_avg_difficulty, 6) AS recent_avg_difficulty FROM prof"""
    rc = rnd(REC_COLS).replace("sample_size", "CAST(sample_size AS BIGINT) AS sample_size")
    q["recommendations"] = with_(*rec_base, recs_sql("cat_sig", "recs")) + f"SELECT {rc} FROM recs"
    q["recommendations_all"] = with_(*rec_base, recs_sql("cat_all", "recs")) + f"SELECT {rc} FROM recs"
    gi = {("problem_id" if k == "id_of_submission_task" else k): v for k, v in CAT_COLS.items()}
    q["global_insights"] = with_(*rec_base) + f"""
      SELECT {fix(rnd(gi))} FROM (SELECT * RENAME (id_of_submission_task AS problem_id) FROM cat_sig
                                   ORDER BY att_score DESC NULLS LAST, id_of_submission_task LIMIT 20)"""
    q["problem_details"] = with_(*rec_base, GRAPH) + """,
      coh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id_of_submission_task
                                         ORDER BY rating_gain_20 DESC, handle, time) AS rn
                             FROM cem WHERE rating_gain_20 > 0
                               AND id_of_submission_task IN (SELECT id_of_submission_task FROM signif))
              WHERE rn <= 5),
      su AS (SELECT id_of_submission_task,
                    string_agg(handle || ':' || CAST(CAST(rating_at_submission AS BIGINT) AS VARCHAR) || ':'
                               || CAST(CAST(future_rating_20 AS BIGINT) AS VARCHAR) || ':'
                               || CAST(CAST(rating_gain_20 AS BIGINT) AS VARCHAR), ','
                               ORDER BY rating_gain_20 DESC, handle, rating_at_submission, future_rating_20) AS s
             FROM coh GROUP BY ALL),
      ns AS (SELECT source_problem AS id_of_submission_task,
                    string_agg(target_problem || ':' || CAST(CAST(round(transition_probability * 1000000) AS BIGINT) AS VARCHAR),
                               ',' ORDER BY transition_probability DESC, target_problem) AS s
             FROM (SELECT *, row_number() OVER (PARTITION BY source_problem
                                               ORDER BY transition_probability DESC, target_problem) AS r
                   FROM graph) WHERE r <= 5 GROUP BY ALL)
      SELECT """ + ", ".join(f"c.{x}" if kind == "k" else f"round(c.{x}, 6) AS {x}" for x, kind in CAT_COLS.items()
                             if x != "total_treated_samples") + """,
             CAST(total_treated_samples AS BIGINT) AS total_treated_samples,
             coalesce(su.s, '') AS similar_users, coalesce(ns.s, '') AS next_steps
      FROM cat_sig c LEFT JOIN su USING (id_of_submission_task) LEFT JOIN ns USING (id_of_submission_task)"""
    q["recommendations_enriched"] = with_(*rec_base, recs_sql("cat_all", "recs")) + f"""
      SELECT handle, rec_rank, problem_id, 'Unknown Problem' AS title, 0 AS n_tags,
             {dtier('estimated_difficulty')} AS difficulty_tier, uplift > 50 AS high_impact,
             CASE WHEN p_value < 0.001 THEN 'Very High' ELSE 'High' END AS confidence,
             CASE WHEN median_time_to_improve >= 0 THEN round(median_time_to_improve / 10) END AS days_to_improve,
             substring(problem_id, 1, length(problem_id) - 1) AS contest_id,
             substring(problem_id, length(problem_id), 1) AS problem_index
      FROM recs"""
    q["user_tiers"] = with_(*CORE, PROF) + """
      SELECT handle, current_rating,
             CASE WHEN current_rating >= 3000 THEN 'legendary' WHEN current_rating >= 2600 THEN 'grandmaster'
                  WHEN current_rating >= 2400 THEN 'master' WHEN current_rating >= 1900 THEN 'candidate'
                  WHEN current_rating >= 1600 THEN 'expert' WHEN current_rating >= 1400 THEN 'specialist'
                  WHEN current_rating >= 1200 THEN 'pupil' ELSE 'newbie' END AS rating_tier
      FROM prof"""
    q["user_potential"] = with_(*rec_base, recs_sql("cat_all", "recs")) + """
      SELECT handle, current_rating, round(sum(uplift), 6) AS potential_gain, count(problem_id) AS n_recommended,
             current_rating - 200 AS range_low, current_rating + 300 AS range_high
      FROM recs GROUP BY handle, current_rating"""
    q["recommend_reachable"] = with_(*rec_base, GRAPH) + """,
      last AS (SELECT handle, pid AS last_solved FROM sol QUALIFY row_number() OVER (PARTITION BY handle
               ORDER BY time DESC, pid DESC, rating_at_submission DESC, problem_rating DESC NULLS LAST) = 1),
      cand AS (SELECT p.handle, p.current_rating, l.last_solved, c.id_of_submission_task, c.att_score, c.final_score
               FROM prof p JOIN last l USING (handle)
               JOIN graph g ON g.source_problem = l.last_solved
               JOIN cat_all c ON c.id_of_submission_task = g.target_problem
               WHERE c.estimated_difficulty BETWEEN p.current_rating - 200 AND p.current_rating + 400)
      SELECT p.handle, p.current_rating, l.last_solved, rec_rank, id_of_submission_task AS problem_id,
             round(att_score, 6) AS uplift, round(final_score, 6) AS final_score,
             CASE WHEN id_of_submission_task IS NULL THEN 'no_match' ELSE 'success' END AS status
      FROM prof p LEFT JOIN last l USING (handle)
      LEFT JOIN (SELECT handle, id_of_submission_task, att_score, final_score,
                        CAST(row_number() OVER (PARTITION BY handle ORDER BY final_score DESC NULLS LAST,
                                                id_of_submission_task) AS INTEGER) AS rec_rank FROM cand
                 QUALIFY rec_rank <= 5) c ON c.handle = p.handle"""
    q["recommend_diverse"] = with_(*rec_base) + f""",
      ratings AS (SELECT DISTINCT current_rating FROM prof),
      cand AS (SELECT r.current_rating, c.*, {dtier('c.estimated_difficulty')} AS primary_tag
               FROM ratings r JOIN cat_all c
                 ON c.estimated_difficulty BETWEEN r.current_rating - 200 AND r.current_rating + 400),
      capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY current_rating, primary_tag
                                   ORDER BY final_score DESC NULLS LAST, id_of_submission_task) AS tr FROM cand)
                 WHERE tr <= 2),
      top AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY current_rating
                                ORDER BY final_score DESC NULLS LAST, id_of_submission_task) AS INTEGER) AS rec_rank
                             FROM capped) WHERE rec_rank <= 5)
      SELECT p.handle, p.current_rating, t.rec_rank, t.id_of_submission_task AS problem_id, t.primary_tag,
             round(t.final_score, 6) AS final_score,
             CASE WHEN t.id_of_submission_task IS NULL THEN 'no_match' ELSE 'success' END AS status
      FROM prof p LEFT JOIN top t USING (current_rating)"""
    q["uplift_by_band"] = with_(*rec_base) + """
      SELECT CAST(floor(estimated_difficulty / 100) * 100 AS INTEGER) AS difficulty_band,
             round(avg(att_score), 6) AS mean_uplift, count(*) AS problems
      FROM cat_all WHERE estimated_difficulty IS NOT NULL GROUP BY ALL"""
    q["uplift_by_gap"] = with_(*ATT_CHAIN) + """
      SELECT gap_band, round(sum(uplift * treated_count) / sum(treated_count), 6) AS mean_uplift,
             CAST(sum(treated_count) AS BIGINT) AS treated_samples, count(*) AS cells
      FROM (SELECT e.*, CAST(floor((m.estimated_difficulty - e.bin_rating * 100) / 100) * 100 AS INTEGER) AS gap_band
            FROM eff e JOIN meta m USING (id_of_submission_task))
      WHERE gap_band IS NOT NULL GROUP BY gap_band"""
    # stored artefacts read back
    q["ingested_submissions"] = q["clean_submissions"]
    q["stored_features"] = q["user_features"]
    q["stored_catalog"] = with_(*rec_base) + f"SELECT {fix(rnd(CAT_COLS))} FROM cat_sig"
    # problem dimension
    q["problem_dimension"] = with_(DIM) + "SELECT id_of_submission_task, title, array_to_string(tags, ', ') AS tags FROM dim"
    q["tag_index"] = with_(*rec_base, DIM) + """,
      t AS (SELECT id_of_submission_task AS pid, unnest(tags) AS tag FROM dim),
      x AS (SELECT t.tag, t.pid, c.att_score, row_number() OVER (PARTITION BY t.tag, c.att_score IS NULL
                   ORDER BY c.final_score DESC NULLS LAST, t.pid) AS r
            FROM t LEFT JOIN cat_all c ON c.id_of_submission_task = t.pid)
      SELECT tag, count(*) AS n_problems, count(att_score) AS n_tested, round(avg(att_score), 6) AS mean_uplift,
             coalesce(string_agg(pid, ',' ORDER BY r) FILTER (WHERE att_score IS NOT NULL AND r <= 5), '') AS best_problems
      FROM x GROUP BY tag"""
    q["recommendations_titled"] = with_(*rec_base, recs_sql("cat_all", "recs"), DIM) + f"""
      SELECT handle, rec_rank, problem_id, coalesce(d.title, 'Unknown Problem') AS title,
             coalesce(array_to_string(d.tags, ','), '') AS tags, CAST(coalesce(len(d.tags), 0) AS INTEGER) AS n_tags,
             {dtier('estimated_difficulty')} AS difficulty_tier
      FROM recs LEFT JOIN dim d ON d.id_of_submission_task = recs.problem_id"""
    rounds = "".join(f""",
      st{k + 1} AS (SELECT s.current_rating, CASE WHEN b.pid IS NULL THEN s.picked ELSE list_append(s.picked, b.pid) END AS picked,
                           CASE WHEN b.pid IS NULL THEN s.used ELSE list_concat(s.used, b.tags) END AS used
                    FROM st{k} s LEFT JOIN (
                      SELECT c.current_rating, c.pid, c.tags FROM cand c JOIN st{k} s USING (current_rating)
                      WHERE NOT list_contains(s.picked, c.pid)
                        AND len(list_filter(c.tags, lambda t: len(list_filter(s.used, lambda u: u = t)) >= 2)) = 0
                      QUALIFY row_number() OVER (PARTITION BY c.current_rating ORDER BY c.final_score DESC NULLS LAST, c.pid) = 1
                    ) b USING (current_rating))""" for k in range(5))
    q["recommend_diverse_tags"] = with_(*rec_base, DIM) + f""",
      ratings AS (SELECT DISTINCT current_rating FROM prof),
      cand AS (SELECT r.current_rating, c.id_of_submission_task AS pid, c.final_score,
                      CASE WHEN len(d.tags) > 0 THEN list_sort(d.tags) ELSE [{dtier('c.estimated_difficulty')}] END AS tags
               FROM ratings r JOIN cat_all c
                 ON c.estimated_difficulty BETWEEN r.current_rating - 200 AND r.current_rating + 400
               LEFT JOIN dim d USING (id_of_submission_task)),
      st0 AS (SELECT current_rating, CAST([] AS VARCHAR[]) AS picked, CAST([] AS VARCHAR[]) AS used FROM ratings){rounds},
      top AS (SELECT current_rating, unnest(picked) AS pid, unnest(range(1, len(picked) + 1)) AS rec_rank FROM st5)
      SELECT p.handle, p.current_rating, CAST(t.rec_rank AS INTEGER) AS rec_rank, t.pid AS problem_id, c.tags[1] AS primary_tag,
             array_to_string(c.tags, ',') AS tags, round(c.final_score, 6) AS final_score,
             CASE WHEN t.pid IS NULL THEN 'no_match' ELSE 'success' END AS status
      FROM prof p LEFT JOIN top t USING (current_rating)
      LEFT JOIN cand c ON c.current_rating = t.current_rating AND c.pid = t.pid"""
    # lineitem at the reference's thresholds
    li = [_li(f) for f in FULL]
    q["li_att_significance"] = with_(*li) + f"SELECT {fix(rnd(SIG_COLS))} FROM sig"
    q["li_placebo_bias"] = with_(*li[:4], _li(PLACEBO_SRC), bias_sql("plsrc", "", "pbias")) + """
      SELECT id_of_submission_task, round(bias_score, 6) AS bias_score,
             round(probability_bias_score, 6) AS probability_bias_score, total_samples FROM pbias"""
    q["li_survival_effects"] = with_(*li) + """
      SELECT id_of_submission_task, round(event_rate, 6) AS event_rate,
             round(median_time_to_improve, 6) AS median_time_to_improve, sample_size,
             round(hazard_ratio, 6) AS hazard_ratio FROM surv"""
    q["li_transition_graph"] = with_(*li[:4], _li(SOL), _li(GRAPH)) + """
      SELECT source_problem, target_problem, transition_count, round(avg_gap, 6) AS avg_gap,
             distinct_users, round(transition_probability, 6) AS transition_probability FROM graph"""
    q["li_recommendations"] = with_(*li, cat_sql("cat_all", "sig"), _li(PROF), recs_sql("cat_all", "recs")) + f"SELECT {rc} FROM recs"
    return q

"""The registered queries once more, as plain SQL for an independent engine.

Ranks are stated as row numbers of a full sort, draws as list filters, mutual
information by its textbook formula: each answer is reached another way than in
the library.
"""

from __future__ import annotations

from surveyloom import fixed_values as fv
from surveyloom.sources import demo

T, FEATURES, VARIABLES = demo.TARGETS, demo.FEATURES, demo.VARIABLES
GAPS = ", ".join(f"'{c}'" for c in fv.MISSING_CODES)
ALL_GAPS = f"'{fv.INAPPLICABLE_CODE}', {GAPS}"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def h32(key: str) -> str:
    return f"cast('0x' || substr(md5({key}), 1, 8) as bigint)"


def columns(names: list[str], form: str) -> str:
    return ", ".join(f"{form.replace('$', n)} as {n}" for n in names)


def every(names: list[str], form: str, glue: str) -> str:
    return glue.join(form.replace("$", n) for n in names)


def _gap(name: str) -> str:
    return (
        f"case {h32(f"'miss:{name}:' || cast(id as varchar)")} % 40 "
        f"when 0 then '.i' when 1 then '.n' when 2 then '.d' when 3 then '.s' else {name} end as {name}"
    )


def _spelled(name: str) -> str:
    entries = {**demo.MISSING_TEXT, **demo.LABELS.get(name, {})}
    cases = " ".join(f"when {text(c)} then {text(v)}" for c, v in entries.items())
    return f"case {name} {cases} else {name} end as {name}"


def _array(values: list[str]) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def _redrawn(labels: bool) -> str:
    """Each target replaced from the list of its other values."""
    out, divisor = [], 1
    for t in T:
        codes = sorted(demo.LABELS[t], key=int)
        domain = [demo.LABELS[t][c] for c in codes] if labels else codes
        others = f"[v for v in {_array(domain)} if v <> {t}]"
        out.append(f"({others})[cast((h // {divisor}) % {len(codes) - 1} as int) + 1] as {t}")
        divisor *= len(codes) - 1
    return ", ".join(out)


def h60(key: str) -> str:
    return f"cast('0x' || substr(md5({key}), 1, 15) as bigint)"


def place(salt: str, key: str) -> str:
    return f"cast(row_number() over (order by md5('{salt}:' || {key})) - 1 as bigint)"


ID = "cast(id as varchar)"
ID_DRAW = f"{ID} || ':' || cast(draw_no as varchar)"
INPUTS = f"""
with base as (
  select o_orderkey as id, cast(1 + o_custkey % 3 as varchar) as wt,
    substr(o_orderpriority, 1, 1) as prio,
    case o_orderstatus when 'F' then '1' when 'O' then '2' else '3' end as status,
    case c_mktsegment when 'AUTOMOBILE' then '1' when 'BUILDING' then '2' when 'FURNITURE' then '3'
      when 'HOUSEHOLD' then '4' else '5' end as seg,
    cast(r_regionkey + 1 as varchar) as region,
    cast(least(26, cast(floor(o_totalprice / 20000) as int) + 1) as varchar) as pricebin,
    cast(c_nationkey as varchar) as nation,
    cast(year(o_orderdate) as varchar) as yr,
    cast(month(o_orderdate) as varchar) as mon,
    cast(cast(floor(c_acctbal / 1000) as int) as varchar) as balbin,
    cast(cast(floor(o_totalprice / 100000) as int) as varchar) as pricegrp
  from orders join customer on o_custkey = c_custkey
    join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
survey_num as (select id, wt, {", ".join(_gap(v) for v in VARIABLES)} from base),
survey_text as (select id, wt, {", ".join(_spelled(v) for v in VARIABLES)} from survey_num),
nulled as (select id, wt, {columns(VARIABLES, f"case when $ in ({GAPS}) then null else $ end")} from survey_num),
answered as (select * from nulled where {every(T, "($ is not null and $ <> '.i')", " and ")}),
prepared as (
  select id, {columns(["wt", *VARIABLES], f"coalesce(try_cast(case when $ in ({ALL_GAPS}) then '-9' else $ end as double), -9.0)")}
  from survey_num where id in (select id from answered)),
real_text as (select * from survey_text where id in (select id from answered)),
quotas as (
  select id, (n + n // 2) // n + case when rk < (n + n // 2) % n then 1 else 0 end as quota
  from (select id, {place("42:quota", ID)} as rk, count(*) over () as n from answered)),
draws as (select id, unnest(range(quota)) as draw_no from quotas),
hashed as (select id, draw_no, {h60(f"'42:draw0:' || {ID_DRAW}")} as h from draws),
candidates_num as (
  select id, draw_no, {", ".join(FEATURES)}, {_redrawn(False)} from hashed join answered using (id)),
candidates_text as (
  select id, draw_no, {", ".join(FEATURES)}, {_redrawn(True)} from hashed join real_text using (id)),
scored as (
  select *, case when {h32(f"'accept:' || {ID_DRAW}")} % 3 = 0 then 1 else 0 end as prediction
  from candidates_text),
sample_ranks as (
  select *, {place("42:sample", ID_DRAW)} as sample_rank, (select count(*) from answered) // 2 as wanted
  from candidates_text),
folded as (
  select id, cast(least(rk // (n // 5), 4) as int) as fold
  from (select id, {place("42:shuffle", ID)} as rk, count(*) over () as n from answered)),
cells as (
  {" union all ".join(f"select id, '{t}' as feature, n.{t} as code, x.{t} as label from survey_num n join survey_text x using (id)" for t in T)}),
label_map as (
  select feature, code, arg_min(label, id) as label, min(id) as first_id
  from cells where try_cast(code as int) is not null group by feature, code),
pairs as (
  {" union all ".join(f"select '{f}' as feature, '{t}' as target, {f} as feature_value, {t} as target_value from prepared" for f in FEATURES for t in T)}),
joint as (
  select feature, target, feature_value, target_value, count(*) as n
  from pairs group by feature, target, feature_value, target_value),
mi as (
  select feature, target, greatest(0.0, sum(n / total * ln(total * n / (by_feature * by_target)))) as mi
  from (
    select feature, target, cast(n as double) as n,
      cast(sum(n) over (partition by feature, target) as double) as total,
      cast(sum(n) over (partition by feature, target, feature_value) as double) as by_feature,
      cast(sum(n) over (partition by feature, target, target_value) as double) as by_target
    from joint)
  group by feature, target),
ranking as (select feature, sum(mi) as mi_sum from mi group by feature),
places as (
  select feature, mi_sum, row_number() over (order by round(mi_sum, 12) desc, feature) as place
  from ranking),
judged as (
  select doc_id, quality, toxic, n_chars from labels join documents using (doc_id)),
estimated as (select *, floor(n_chars / 500) / 4 as guess from judged),
asked as (
  select u.conv_id, u.turn, u.text, b.text as context, a.text as answer
  from conversations u
    left join conversations b on b.conv_id = u.conv_id and b.turn = u.turn - 1
    left join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant'
  where u.role = 'user'),
words as (
  select doc_id, n_chars, [w for w in string_split_regex(text, '[ \\t\\n\\r\\f]+') if w <> ''] as w
  from documents),
records as (
  select doc_id, n_chars, case when coalesce(w[-1], '') <> '</s>'
    then list_append(w, '</s>') else w end as ids
  from words),
real_cov as ({{real_cov}}),
pred_cov as ({{pred_cov}}),
cov_diff as (
  select r.row, r.col, r.cov as true_cov, p.cov as pred_cov, r.cov - p.cov as diff
  from real_cov r join pred_cov p on r.row = p.row and r.col = p.col)
"""


def _covariances(names: list[str], source: str) -> str:
    return " union all ".join(
        f"select '{a}' as row, '{b}' as col, covar_samp({a}, {b}) as cov from {source}"
        for a in names
        for b in names
    )


def _code_case(t: str, kind: str = "varchar") -> str:
    cases = " ".join(f"when {text(v)} then {text(c)}" for c, v in demo.LABELS[t].items())
    return f"cast(case {t} {cases} end as {kind}) as {t}"


_ANSWERS = [*[(t, list(demo.LABELS[t])) for t in T], ("mon", range(1, 13)), ("nation", range(25))]
_NAMED_ANSWERS = ", ".join(f"('{v}={code}')" for v, codes in _ANSWERS for code in codes)
_GIVEN = " union all ".join(f"select id, '{v}=' || cast(cast({v} as int) as varchar) as name from prepared" for v, _ in _ANSWERS)
# both, each and all rows counted: of 0/1 columns these give the covariance
_ANSWER_COVARIANCES = f"""
    select a.name as row, b.name as col,
           round((coalesce(x.n, 0) - coalesce(p.n, 0) * coalesce(q.n, 0) / cast(s.n as double)) / (s.n - 1), 6) + 0.0 as cov
    from (values {_NAMED_ANSWERS}) a(name)
    cross join (values {_NAMED_ANSWERS}) b(name)
    cross join (select count(*) as n from prepared) s
    left join (select name, count(*) as n from ({_GIVEN}) group by name) p on p.name = a.name
    left join (select name, count(*) as n from ({_GIVEN}) group by name) q on q.name = b.name
    left join (select l.name as one, r.name as other, count(*) as n from ({_GIVEN}) l join ({_GIVEN}) r using (id)
               group by l.name, r.name) x on x.one = a.name and x.other = b.name"""

_ENCODED = f"(select {', '.join(_code_case(t, 'double') for t in T)} from scored where prediction = 1)"
INPUTS = INPUTS.format(
    real_cov=_covariances(T, "prepared"), pred_cov=_covariances(T, _ENCODED)
)


def r(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0"


def _binary(truth: str, guess: str) -> dict[str, str]:
    tp = f"count(*) filter ({truth} = 1 and {guess} = 1)"
    fp = f"count(*) filter ({truth} <> 1 and {guess} = 1)"
    fn = f"count(*) filter ({truth} = 1 and {guess} <> 1)"
    return {
        "accuracy": f"count(*) filter ({truth} = {guess}) / cast(count(*) as double)",
        "f1": f"coalesce(2.0 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 0)",
        "precision": f"coalesce({tp} / cast(nullif({tp} + {fp}, 0) as double), 0)",
        "recall": f"coalesce({tp} / cast(nullif({tp} + {fn}, 0) as double), 0)",
    }


def _named(parts: dict[str, str]) -> str:
    return ", ".join(f"{r(e)} as {n}" for n, e in parts.items())


RULE = "case when n_chars >= 1000 then 1 else 0 end"
LEDGER = " union all ".join(
    f"select {i} as grid_no, {limit} as length_limit, "
    + _named({k: v for k, v in _binary("quality", f"(n_chars >= {limit})::int").items() if k in ("accuracy", "f1")})
    + " from judged"
    for i, limit in enumerate([500, 1000, 2000, 4000])
)
RMSE = "sqrt(avg(pow({} - quality, 2)))"
RMSES = {
    "rmse": RMSE.format("guess"),
    "integerized_rmse": RMSE.format("round_even(guess, 0)"),
    "label_precision_rmse": RMSE.format("case when round_even(guess, 0) = quality then quality else guess end"),
}


def _phrase(name: str) -> str:
    return f"'{demo.DICTIONARY[name]} is ' || coalesce({name}, 'nan') || '. '"


PROMPT = f"{text(fv.PROMPT_PREFIX)} || " + " || ".join(
    f"case when {v} = 'iap' then '' else {_phrase(v)} end" for v in VARIABLES if v in FEATURES
)
SUFFIX = f"{text(fv.SUFFIX_PREFIX)} || " + " || ".join(_phrase(t) for t in T)


def _ranked_text(source: str, key: str) -> str:
    """Feature phrases in the order of the ranking, then the targets."""
    phrases = " union all ".join(
        f"select {key}, '{f}' as feature, case when {f} = 'iap' then '' else {_phrase(f)} end as phrase from {source}"
        for f in FEATURES
    )
    return (
        f"select {key}, {text(fv.PROMPT_PREFIX)} || string_agg(phrase, '' order by place) as body "
        f"from ({phrases}) join places using (feature) group by {key}"
    )


def _template(with_input: bool) -> str:
    parts = ["'Task:\n' || text || '\n\n"]
    if with_input:
        parts.append("Context:\n' || context || '\n\n")
    return "".join(parts) + "Answer:\n'"


WHITE = " || ".join(
    f"chr({c})"
    for c in [
        9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239,
        8287, 12288,
    ]
)
RELEVANT = {"truth": "case when truth = -9 then 0 when truth between -2 and 2 then 1 else truth end",
            "guess": "case when guess = -9 then 0 when guess between -2 and 2 then 1 else guess end"}
CODED = (
    "(select case when toxic = 1 then -9 else quality - 1 end as truth, "
    "case when n_chars % 7 = 0 then -9 else cast(n_chars % 4 - 2 as int) end as guess from judged)"
)


def _u(name: str) -> str:
    key = f"'42:{name}:' || cast(fold as varchar) || ':' || cast(trial as varchar)"
    return f"({h32(key)} / 4294967296.0::double)"


def _choice(name: str, values: list) -> str:
    kind = "double" if isinstance(values[0], float) else "int"
    listed = "[" + ", ".join(f"cast({v} as {kind})" for v in values) + "]"
    return f"{listed}[cast(floor({_u(name)} * {len(values)}) as int) + 1] as {name}"


_LOW, _HIGH = fv.SEARCH_EPOCH_RANGE
DRAWN = ", ".join(_choice(n, v) for n, v in fv.SEARCH_CHOICES.items()) + (
    f", cast(greatest({_LOW}, least({_HIGH}, floor(exp({_u('num_train_epochs')} * "
    f"(ln({_HIGH + 1}) - ln({_LOW})) + ln({_LOW}))))) as int) as num_train_epochs"
)
FOLD_SIZES = (
    f"select cast({h32(f"'42:fold:' || {ID}")} % 5 as int) as fold, count(*) as test_rows "
    "from answered group by 1"
)
LABELLED = "select id, 1 as labels from answered union all select id, 0 from sample_ranks where sample_rank < wanted"


def _fold_facts(folds: int) -> str:
    """Rows, real rows and majority rate of each fold of the training rows, folds by source id."""
    larger = "cast(greatest(sum(labels), count(*) - sum(labels)) as double) / count(*)"
    return (
        f"select fold, count(*) as test_rows, cast(sum(labels) as bigint) as positives, {r(larger)} as majority_rate, "
        f"true as beats_majority from (select labels, cast({h32(f"'42:fold:' || {ID}")} % {folds} as int) as fold "
        f"from ({LABELLED})) group by fold"
    )


def _trial_u(name: str) -> str:
    return f"({h32(f"'42:{name}:0:' || cast(trial as varchar)")} / 4294967296.0)"


def _trial_choice(name: str) -> str:
    values = fv.SEARCH_CHOICES[name]
    kind = "double" if isinstance(values[0], float) else "int"
    return f"cast(({values})[cast(floor({_trial_u(name)} * {len(values)}) as int) + 1] as {kind}) as {name}"


VALUE_TOKENS = [f"'{c}=' || coalesce(cast({c} as varchar), 'nan')" for c in [*FEATURES, *T]]
CROSSED_TOKENS = [
    *VALUE_TOKENS,
    *(f"{f} || '&' || {t}" for f in VALUE_TOKENS[: len(FEATURES)] for t in VALUE_TOKENS[len(FEATURES) :]),
    *(f"{a} || '&' || {b}" for i, a in enumerate(VALUE_TOKENS[len(FEATURES) :]) for b in VALUE_TOKENS[len(FEATURES) + i + 1 :]),
]


def _listed(tokens: list[str]) -> str:
    """(id, token, place) of the answered rows."""
    return f"select id, unnest([{', '.join(tokens)}]) as token, unnest(range({len(tokens)})) as place from real_text"


def _vocabulary(tokens: list[str]) -> str:
    return (
        f"select token, {place('42:vocabulary', 'token')} as number, rows "
        f"from (select token, count(*) as rows from ({_listed(tokens)}) group by token)"
    )


def _trial_epochs(low: int, high: int) -> str:
    drawn = f"floor(exp(ln({low}) + {_trial_u('num_train_epochs')} * (ln({high + 1}) - ln({low}))))"
    return f"cast(greatest({low}, least({high}, {drawn})) as int)"


TARGETS = ", ".join(T)
NAMES = ", ".join(FEATURES)

BODIES: dict[str, str] = {
    "scan_numeric": "select * from survey_num",
    "scan_text": "select * from survey_text",
    "variable_dictionary": (
        "select p_brand as name, arg_max(p_name, p_partkey) as simplab from part group by p_brand"
    ),
    "code_map_scan": "select feature, code, label from label_map",
    "code_map_lines": "select feature, code, label from label_map",
    "split_read": (
        "select case when fold = 0 then 'test' else 'train' end as split, id, fold from folded "
        "union all select 'validate' as split, id, fold from folded where fold = 0"
    ),
    "candidate_scan": f"select id, draw_no, {TARGETS} from candidates_num",
    "sink_roundtrip": f"select 'f4-0' as run_id, 'full' as split, id, {NAMES}, {TARGETS} from prepared",
    "code_map_json": (
        "select feature, '{' || string_agg('\"' || code || '\":\"' || label || '\"', ',' order by code)"
        " || '}' as entries from label_map group by feature"
    ),
    "result_ledger": LEDGER,
    "project_columns": f"select id, nation, yr, {TARGETS} from prepared",
    "drop_columns": f"select id, {NAMES} from prepared",
    "feature_stoplist": " union all ".join(
        f"select '{f}' as variable, count(*) - count({f}) as nulls from nulled" for f in FEATURES
    ),
    "filter_applicable": f"select * from survey_num where {every(T, "$ <> '.i'", ' and ')}",
    "dropna_targets": f"select * from nulled where {every(T, '$ is not null', ' and ')}",
    "codes_to_null": "select * from nulled",
    "fill_sentinel": (
        f"select id, wt, {columns(VARIABLES, "case when $ is null or $ = '.i' then '-9' else $ end")} from nulled"
    ),
    "to_numeric": f"select id, {columns(['wt', *VARIABLES], 'try_cast($ as double)')} from survey_num",
    "is_code": f"select id, {columns(VARIABLES, 'try_cast($ as int) is not null')} from survey_num",
    "accepted_rows": f"select id, draw_no, {TARGETS} from scored where prediction = 1",
    "value_remap": (
        "select id, cast(balbin as int) as code, cast(case when balbin = -9 then 0 "
        "when balbin between -2 and 2 then 1 else balbin end as int) as remapped from prepared"
    ),
    "fold_split": "select id, fold, case when fold = 4 then 'test' else 'train' end as split from folded",
    "encode_targets": "select id, draw_no, "
    + ", ".join(_code_case(t, "int") + "_num" for t in T)
    + " from scored",
    "semi_join_ids": "select * from real_text",
    "holdout_anti_join": f"select id, draw_no, {TARGETS} from sample_ranks where sample_rank >= wanted",
    "train_complement": "select id, fold from folded where fold <> 0",
    "code_label_join": "select id, feature, code, label from cells",
    "label_to_code": f"select id, {', '.join(_code_case(t) for t in T)} from survey_text",
    "code_to_label": (
        f"select id, {columns(T, "case when $ like '.%' then null else $ end")} from "
        f"(select s.id, {columns(T, "case when n.$ like '.%' then '.' else s.$ end")} "
        "from survey_text s join survey_num n using (id))"
    ),
    "fold_by_source": f"select id, cast({h32(f"'42:fold:' || {ID}")} % 5 as int) as fold from answered",
    "param_grid": (
        "select fold, test_rows, cast(3 * k.i + e.i as int) as grid_no, 900 as cutoff_len, "
        "k.v as feature_count, e.v as num_epochs, cast(0.001 as double) as learning_rate "
        f"from ({FOLD_SIZES}), (values (0, 50), (1, 100), (2, 120)) k(i, v), "
        "(values (0, 2), (1, 3), (2, 4)) e(i, v)"
    ),
    "expand_draws": "select id, draw_no from draws",
    "contingency": "select * from joint",
    "mutual_information": f"select feature, target, {r('mi')} as mi from mi",
    "mi_sum": (
        "select feature, "
        + ", ".join(f"{r(f"sum(mi) filter (target = '{t}')")} as {t}" for t in T)
        + f", {r('sum(mi)')} as mi_sum from mi group by feature"
    ),
    "missing_code_counts": " union all ".join(
        f"select '{c}' as code, cast({' + '.join(f"count(*) filter ({v} = '{c}')" for v in VARIABLES)} as bigint) as cells from survey_num"
        for c in fv.PROFILED_CODES
    ),
    "null_profile": " union all ".join(
        f"select '{v}' as variable, count(*) - count({v}) as nulls from nulled"
        for v in ["id", "wt", *VARIABLES]
    ),
    "split_counts": "select fold, count(*) as rows from folded group by fold",
    "feature_domains": (
        "select feature, string_agg(code, ',' order by cast(code as int)) as domain "
        "from label_map group by feature"
    ),
    "label_map": "select feature, code, label, first_id from label_map",
    "reverse_label_map": (
        "select feature, label, arg_max(code, first_id) as code from (select feature, code, "
        "arg_min(case when code like '.%' then 'no valid answer' else label end, id) as label, "
        "min(id) as first_id from cells group by feature, code) group by feature, label"
    ),
    "covariance_matrix": f"select row, col, {r('cov', 4)} as cov from real_cov",
    "covariance_of_answers": _ANSWER_COVARIANCES,
    "covariance_continuous": f"select row, col, {r('cov', 4)} as cov from ("
    + _covariances(["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "lineitem")
    + ")",
    "covariance_diff": f"select row, col, {r('diff', 4)} as diff from cov_diff",
    "covariance_frobenius": f"select {r('sqrt(sum(diff * diff))', 4)} as frobenius_norm from cov_diff",
    "covariance_clamped": f"select row, col, {r('greatest(-3.0, least(3.0, cov))', 4)} as cov from real_cov",
    "covariance_report": (
        f"select row, col, {r('true_cov', 4)} as true_cov, {r('pred_cov', 4)} as pred_cov, "
        f"{r('diff', 4)} as diff, {r('sqrt(sum(diff * diff) over ())', 4)} as frobenius_norm from cov_diff"
    ),
    "binary_metrics": f"select {_named(_binary('quality', RULE))} from judged",
    "rmse": f"select {r(RMSES['rmse'])} as rmse from estimated",
    "rmse_rounded": f"select {r(RMSES['integerized_rmse'])} as integerized_rmse from estimated",
    "rmse_label_precision": f"select {r(RMSES['label_precision_rmse'])} as label_precision_rmse from estimated",
    "relevance_metrics": (
        f"select {r(_binary('truth', 'guess')['accuracy'])} as accuracy, "
        + ", ".join(
            f"{r(e)} as relevant_{n}"
            for n, e in _binary(f"({RELEVANT['truth']})", f"({RELEVANT['guess']})").items()
        )
        + f", {r('sqrt(avg(pow(guess - truth, 2)) filter (truth <> -9 and guess <> -9))')} as rmse from {CODED}"
    ),
    "metrics_by_task": " union all ".join(
        [f"select 'class' as task_type, '{n}' as metric, {r(e)} as value from judged"
         for n, e in _binary("quality", RULE).items()]
        + [f"select 'continuous' as task_type, '{n}' as metric, {r(e)} as value from estimated"
           for n, e in RMSES.items()]
    ),
    "token_length_histogram": (
        "select cast(b as int) as bin, "
        f"{r('lo + b * (hi - lo) / 40')} as bin_start, {r('lo + (b + 1) * (hi - lo) / 40')} as bin_end, "
        "(select count(*) from records where least(floor((len(ids) - lo) * 40 / (hi - lo)), 39) = b) as n "
        "from (select cast(min(len(ids)) as double) as lo, cast(max(len(ids)) as double) as hi from records), "
        "range(40) t(b)"
    ),
    "best_config": f"select * from ({LEDGER}) order by accuracy desc, length_limit limit 1",
    "assign_quota": (
        "select id, cast((2 * n + 7) // n + case when rk < (2 * n + 7) % n then 1 else 0 end as bigint) as quota "
        f"from (select id, {place('42:quota', ID)} as rk, count(*) over () as n from answered)"
    ),
    "exact_sample": (
        f"select id, {TARGETS} from (select *, {place('42:sample', ID)} as rk, "
        "count(*) over () as n from answered) where rk < n // 3"
    ),
    "shuffle_index": f"select id, {TARGETS}, {place('42:shuffle', ID)} as index from answered",
    "kfold_assign": "select id, fold from folded",
    "draw_alternative": (
        f"select id, {_redrawn(False)} from (select *, {h60(f"'42:draw0:' || {ID}")} as h from answered)"
    ),
    "generate_candidates": f"select id, draw_no, {NAMES}, {TARGETS} from candidates_text",
    "top_k_features": f"select feature, {r('mi_sum')} as mi_sum from places where place <= 3",
    "labelled_union": (
        f"select id, cast(-1 as bigint) as draw_no, {NAMES}, {TARGETS}, 1 as labels from real_text union all "
        f"select id, draw_no, {NAMES}, {TARGETS}, 0 as labels from sample_ranks where sample_rank < wanted"
    ),
    "compile_prompt": f"select id, {PROMPT} as prompt from survey_text",
    "compile_suffix": f"select id, {SUFFIX} as suffix from survey_text",
    "compile_text": f"select id, {PROMPT} || {SUFFIX} as text from survey_text",
    "row_to_json": f"select id, cast(to_json([{NAMES}, {TARGETS}]) as varchar) as json from survey_text",
    "json_to_ids": (
        "select event_id, json_extract_string(props, '$.k') || ' ' || cast(user_id as varchar) as input_ids, "
        "'1 1' as attention_mask, value as labels from events"
    ),
    "fill_template": (
        f"select conv_id, turn, case when coalesce(context, '') = '' then {_template(False)} "
        f"else {_template(True)} end || coalesce(answer, '') as prompt from asked"
    ),
    "extract_response": (
        "select doc_id, case when contains(text, '.' || chr(10)) then "
        f"trim(split_part(text, '.' || chr(10), 2), {WHITE}) end as response from documents"
    ),
    "token_arrays": (
        "select doc_id, array_to_string(ids, ' ') as input_ids, cast(len(ids) as int) as mask_length, "
        "cast(n_chars % 2 as int) as labels from records"
    ),
    "loss_mask": (
        "select conv_id, turn, array_to_string(list_concat(p, a), ' ') as input_ids, "
        "array_to_string(list_concat([ '-100' for w in p ], a), ' ') as labels, "
        "cast(len(p) + len(a) as int) as mask_length from (select conv_id, turn, "
        "[w for w in string_split_regex(text, '[ \\t\\n\\r\\f]+') if w <> ''] as p, "
        "list_append([w for w in string_split_regex(answer, '[ \\t\\n\\r\\f]+') if w <> ''], '</s>') as a "
        "from asked where answer is not null)"
    ),
    "pad_batches": (
        "select doc_id, batch_no, cast(longest as int) as length, cast(longest - len(ids) as int) as padding, "
        "md5(array_to_string(list_concat([ '0' for i in range(longest - len(ids)) ], ids), ' ')) as ids_md5 "
        "from (select *, max(len(ids)) over (partition by batch_no) as longest from "
        f"(select *, {place('42:batch', 'cast(doc_id as varchar)')} // 32 as batch_no from records))"
    ),
    "argmax_scores": (
        "select vec_id, cast(list_position(embedding, list_max(embedding)) - 1 as int) as prediction from embeddings"
    ),
    "train_plausibility": f"select labels, count(*) as rows, true as mostly_right from ({LABELLED}) group by labels",
    "evaluate_fold": f"select * from ({_fold_facts(5)}) where fold = 0",
    "cross_validate": _fold_facts(3),
    "score_candidates": f"select id, draw_no, {TARGETS}, true as sound from sample_ranks where sample_rank >= wanted",
    "score_saved_model": f"select id, draw_no, {TARGETS}, true as sound from sample_ranks where sample_rank >= wanted",
    "search_best": (
        f"select trial, {_trial_epochs(1, 4)} as num_epochs, "
        f"cast(({fv.SEARCH_CHOICES['weight_decay']})[cast(floor({_trial_u('weight_decay')} * "
        f"{len(fv.SEARCH_CHOICES['weight_decay'])}) as int) + 1] as double) as weight_decay, true as beats_majority "
        "from (select cast(range as int) as trial from range(4))"
    ),
    "token_vocabulary": _vocabulary(VALUE_TOKENS),
    "token_numbers": (
        "select id, string_agg(cast(number as varchar), ' ' order by place) as numbers "
        f"from ({_listed(VALUE_TOKENS)}) join ({_vocabulary(VALUE_TOKENS)}) using (token) group by id"
    ),
    "exact_vectors": (
        f"select id, (select count(*) from ({_vocabulary(CROSSED_TOKENS)})) as size, "
        "string_agg(cast(number as varchar), ',' order by number) as places "
        f"from ({_listed(CROSSED_TOKENS)}) join ({_vocabulary(CROSSED_TOKENS)}) using (token) group by id"
    ),
    "factor_cross_validate": _fold_facts(3),
    "factor_search": (
        f"select trial, {', '.join(_trial_choice(n) for n in fv.SEARCH_CHOICES)}, "
        f"{_trial_epochs(*fv.SEARCH_EPOCH_RANGE)} as num_train_epochs, true as best_beats_majority "
        "from (select cast(range as int) as trial from range(8))"
    ),
    "task_models": (
        f"select feature, task_type, fold, test_rows, metric, true as sound from (select cast({h32(f"'42:fold:' || {ID}")} % 2 as int) as fold, "
        "count(*) as test_rows from answered group by 1), (values ('west', 'class'), ('price', 'continuous'), "
        "('region', 'sequence'), ('seg', 'class')) t(feature, task_type) join (values ('class', 'accuracy'), ('class', 'f1'), "
        "('class', 'precision'), ('class', 'recall'), ('continuous', 'rmse'), ('continuous', 'integerized_rmse'), "
        "('continuous', 'label_precision_rmse'), ('sequence', 'rmse'), ('sequence', 'integerized_rmse'), "
        "('sequence', 'label_precision_rmse')) m(kind, metric) on task_type = kind"
    ),
    "encode_by_map": f"select id, {columns([*FEATURES, *T], 'case when try_cast($ as int) is not null then $ end')} from survey_num",
    "experiment": (
        "select f.v as feature_count, g.i as grid_no, g.v as num_epochs, cast(0.01 as double) as weight_decay, "
        f"fold, test_rows, majority_rate, true as complete from ({_fold_facts(3)}), (values (2), (4)) f(v), "
        "(values (0, 2), (1, 3), (2, 4)) g(i, v)"
    ),
    "param_draws": (
        f"select fold, test_rows, trial, {DRAWN} from ({FOLD_SIZES}), "
        "(select cast(range as int) as trial from range(8))"
    ),
    "score_with_user_model": f"select doc_id, n_chars, quality, {RULE} as prediction from judged",
    "prepare_numeric": "select * from prepared",
    "select_features": f"select feature, {r('mi_sum')} as mi_sum from places where place <= 3",
    "training_set": (
        f"select id, 1 as labels, body || {SUFFIX} as text from ({_ranked_text('real_text', 'id')}) join real_text using (id) "
        f"union all select id, 0 as labels, body || {SUFFIX} as text from ({_ranked_text('candidates_text', 'id, draw_no')}) "
        "join sample_ranks using (id, draw_no) where sample_rank < wanted"
    ),
    "remaining_candidates": (
        f"select id, body || {SUFFIX} as text, {TARGETS} from ({_ranked_text('candidates_text', 'id, draw_no')}) "
        "join sample_ranks using (id, draw_no) where sample_rank >= wanted"
    ),
    "label_maps": (
        "select feature, code as key, label as value, 'label_map' as map from label_map union all "
        "select feature, label as key, arg_max(code, first_id) as value, 'reverse_label_map' as map "
        "from label_map group by feature, label"
    ),
}
ORACLES = {name: INPUTS + body for name, body in BODIES.items()}

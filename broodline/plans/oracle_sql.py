"""DuckDB oracle SQL for every registered query.

Written independently of the Spark operators and close to the reference's row-level
formulation (grouped ``mutate`` -> window aggregates over all rows, ``lag`` over the
full record grid, keep-first via ``row_number``), so the comparison checks the
aggregate-first Spark plans against the literal semantics.
"""

from __future__ import annotations

from broodline.operators.linear import EXACT_T, t_quantile
from broodline.sources.adapters import BROOD_VIEW_SQL, CAPTURE_VIEW_SQL

# ---------------------------------------------------------------------------
# CTE chain (later CTEs use earlier ones; DuckDB drops unused ones)
# ---------------------------------------------------------------------------
_EXP_NONE_PAIRING = "('NA;NA;NA','NA','FALSE','','UNKNOWN')"
_EXP_NONE = "('NA;NA;NA','NA','FALSE')"

PAIR_CTES = f"""
brood AS ({BROOD_VIEW_SQL}),
capture AS ({CAPTURE_VIEW_SQL}),
ref AS (
  select row_ord, PopID, BreedingSeason, LocationID,
    upper(case when FemaleID = '1000000' then null else FemaleID end) as FemaleID,
    upper(case when MaleID in ('1000000','UNKNOWN') then null else MaleID end) as MaleID,
    case when ExperimentID is null or ExperimentID in {_EXP_NONE_PAIRING}
      or ExperimentID like '%control%' then false else true end as Brood_exp,
    LayDate_observed, ClutchType_calculated
  from brood where Species = 'PARMAJ' and (FemaleID is not null or MaleID is not null)
),
dedup AS (
  select * exclude (rn) from (
    select *, row_number() over (partition by PopID, BreedingSeason, FemaleID, MaleID
                                 order by row_ord) as rn from ref) where rn = 1
),
cp0 AS (
  select *,
    case when FemaleID is not null then count(distinct MaleID) over wf end as Num_male_partners,
    case when min(MaleID) over wf = max(MaleID) over wf then min(MaleID) over wf end as MaleID_known,
    case when MaleID is not null then count(distinct FemaleID) over wm end as Num_female_partners,
    case when min(FemaleID) over wm = max(FemaleID) over wm then min(FemaleID) over wm end as FemaleID_known
  from dedup
  window wf as (partition by PopID, FemaleID, BreedingSeason),
         wm as (partition by PopID, MaleID, BreedingSeason)
),
clean_pairs AS (
  select *,
    case when Num_male_partners = 2 then MaleID else MaleID_known end as MaleID_recode,
    case when Num_female_partners = 2 then FemaleID else FemaleID_known end as FemaleID_recode
  from cp0
),
first_lit AS (
  select PopID, FemaleID as IndvID, min(BreedingSeason) as breed_year
  from clean_pairs where FemaleID is not null and MaleID is not null
    and PopID is not null and BreedingSeason is not null group by PopID, FemaleID
),
first_both AS (
  select PopID, IndvID, min(BreedingSeason) as breed_year from (
    select PopID, BreedingSeason, FemaleID as IndvID from clean_pairs
    union all select PopID, BreedingSeason, MaleID from ref) u
  where PopID is not null and BreedingSeason is not null and IndvID is not null
  group by PopID, IndvID
),
"""


def _cap_chain(first: str, sfx: str) -> str:
    """Capture enrichment -> full joins -> flags -> order -> final pairs, for one
    first-season variant; CTE names get suffix ``sfx``."""
    return f"""
cap0{sfx} AS (
  select c.row_ord, c.CapturePopID as PopID, c.BreedingSeason, c.IndvID, c.Sex_observed,
    case when c.ExperimentID in {_EXP_NONE} or c.ExperimentID like '%control%' then null
         else c.ExperimentID end as ExperimentID,
    c.CaptureDate
  from capture c join {first} f on c.CapturePopID = f.PopID and c.IndvID = f.IndvID
  where c.Species = 'PARMAJ' and c.BreedingSeason >= f.breed_year
),
cap_en{sfx} AS (
  select * exclude (rn) from (
    select PopID, BreedingSeason, IndvID, Sex_observed, CaptureDate,
      bool_or(ExperimentID is not null) over (partition by PopID, IndvID) as Cap_exp,
      count(distinct BreedingSeason) over (partition by PopID, IndvID) as years,
      'yes' as capture, row_ord,
      row_number() over (partition by PopID, IndvID, BreedingSeason order by row_ord) as rn
    from cap0{sfx}) where rn = 1
),
bp{sfx} AS (
  select PopID, BreedingSeason, LocationID, ClutchType_calculated, LayDate_observed, Brood_exp,
    'yes' as brood, FemaleID, MaleID, Num_male_partners, Num_female_partners,
    0 as source_rank, row_ord
  from clean_pairs
),
j1{sfx} AS (
  select coalesce(b.PopID, c.PopID) as PopID,
    coalesce(b.BreedingSeason, c.BreedingSeason) as BreedingSeason,
    b.LocationID, b.ClutchType_calculated, b.LayDate_observed, b.Brood_exp, b.brood,
    coalesce(b.FemaleID, c.IndvID) as FemaleID, c.CaptureDate as Female_cap_dat,
    c.capture as Record_f, b.Num_male_partners, c.Cap_exp as Female_exp,
    b.MaleID, b.Num_female_partners,
    coalesce(b.source_rank, 1) as source_rank, coalesce(b.row_ord, c.row_ord) as row_ord
  from bp{sfx} b full join (select * from cap_en{sfx} where Sex_observed = 'F') c
    on b.PopID is not distinct from c.PopID and b.BreedingSeason is not distinct from c.BreedingSeason
   and b.FemaleID is not distinct from c.IndvID
),
j2{sfx} AS (
  select coalesce(b.PopID, c.PopID) as PopID,
    coalesce(b.BreedingSeason, c.BreedingSeason) as BreedingSeason,
    b.LocationID, b.ClutchType_calculated, b.LayDate_observed, b.Brood_exp, b.brood,
    b.FemaleID, b.Female_cap_dat, b.Record_f, b.Num_male_partners, b.Female_exp,
    coalesce(b.MaleID, c.IndvID) as MaleID, c.CaptureDate as Male_cap_dat, c.capture as Record_m,
    b.Num_female_partners, c.Cap_exp as Male_exp,
    coalesce(b.source_rank, 2) as source_rank, coalesce(b.row_ord, c.row_ord) as row_ord
  from j1{sfx} b full join (select * from cap_en{sfx} where Sex_observed = 'M') c
    on b.PopID is not distinct from c.PopID and b.BreedingSeason is not distinct from c.BreedingSeason
   and b.MaleID is not distinct from c.IndvID
),
j3{sfx} AS (
  select * replace (
    coalesce(Brood_exp, false) as Brood_exp,
    coalesce(Brood_exp, false) or coalesce(Female_exp, false) as Female_exp,
    coalesce(Brood_exp, false) or coalesce(Male_exp, false) as Male_exp)
  from j2{sfx}
),
built{sfx} AS (
  select * replace (
    bool_or(Female_exp) over (partition by PopID, FemaleID) as Female_exp,
    bool_or(Male_exp) over (partition by PopID, FemaleID) as Male_exp),
    cast(case when ClutchType_calculated = 'first' then 1 when ClutchType_calculated = 'replacement' then 2
         when ClutchType_calculated = 'second' then 3 when ClutchType_calculated is null then 4 end
         as integer) as "order"
  from j3{sfx}
),
po{sfx} AS (
  select *,
    case when nd_f = 1 and Num_male_partners = 2 then 'yes'
         when not (nd_f = 1 and Num_male_partners = 2) then 'no' end as no_order_f,
    case when nd_m = 1 and Num_female_partners = 2 then 'yes'
         when not (nd_m = 1 and Num_female_partners = 2) then 'no' end as no_order_m
  from (select *,
     count(distinct "order") over (partition by PopID, BreedingSeason, FemaleID)
       + max(case when "order" is null then 1 else 0 end) over (partition by PopID, BreedingSeason, FemaleID) as nd_f,
     count(distinct "order") over (partition by PopID, BreedingSeason, MaleID)
       + max(case when "order" is null then 1 else 0 end) over (partition by PopID, BreedingSeason, MaleID) as nd_m
   from built{sfx}) x
),
final{sfx} AS (
  select PopID as pop, LocationID as nest, BreedingSeason as year, FemaleID as female,
    Num_male_partners as f_pair_num, MaleID as male, Num_female_partners as m_pair_num,
    "order", no_order_f, no_order_m, source_rank, row_ord
  from po{sfx} where not Brood_exp and not Female_exp and not Male_exp
),
"""


def _codes_chain(src: str, focal: str, sfx: str, require_known: bool = True) -> str:
    """Literal event codes: full grid, row-level lag, keep-first per year."""
    partner = "male" if focal == "female" else "female"
    pn = "f_pair_num" if focal == "female" else "m_pair_num"
    tie = "source_rank, row_ord" if focal == "female" else "female nulls last, source_rank, row_ord"
    six = "B and K" if require_known else "B"
    return f"""
yrs{sfx} AS (select distinct pop, year from {src}),
foc{sfx} AS (select distinct pop, {focal} from {src} where {focal} is not null),
grid{sfx} AS (
  select pop, year, {focal}, {partner}, {pn}, "order", source_rank, row_ord, true as captured
  from {src} where {focal} is not null
  union all
  select g.pop, g.year, g.{focal}, null, null, null, null, null, false
  from (select f.pop, f.{focal}, y.year from foc{sfx} f join yrs{sfx} y on f.pop is not distinct from y.pop) g
  where not exists (select 1 from {src} s where s.pop is not distinct from g.pop and s.{focal} = g.{focal}
                    and s.year is not distinct from g.year)
),
lagged{sfx} AS (
  select *,
    lag({partner}) over (partition by pop, {focal} order by year nulls last, "order" nulls last, {tie}) as prev,
    bool_or({pn} = 2) over (partition by pop, {focal}) as mp
  from grid{sfx}
),
pres{sfx} AS (
  select pop, year, {partner} as pp, bool_or({focal} is not null) as known
  from {src} where {partner} is not null group by pop, year, {partner}
),
coded{sfx} AS (
  select l.*,
    case when prev is null then null else p.pp is not null end as B,
    case when prev is null then null else coalesce(p.known, false) end as K
  from lagged{sfx} l left join pres{sfx} p on l.pop is not distinct from p.pop
    and l.year is not distinct from p.year and l.prev = p.pp
),
codes{sfx} AS (
  select pop, {focal}, year, cast(case when mp then 1 else 0 end as integer) as multi_partner,
    case
      when not captured and (prev is null or {partner} is null) and B is null then '0'
      when captured and {partner} = prev and {partner} is not null then '1'
      when captured and {partner} is not null and {partner} <> prev then '2'
      when captured and prev is null and {partner} is not null then '3'
      when captured and {partner} is null and prev is not null and B then '4'
      when captured and {partner} is null and (not B or prev is null) then '5'
      when not captured and {six} then '6'
      else '0' end as event_code,
    row_number() over (partition by pop, {focal}, year
                       order by "order" nulls last, {tie}) as rn
  from coded{sfx}
),
"""


def _with(*parts: str) -> str:
    body = "".join(parts).rstrip().rstrip(",")
    return "WITH " + body + "\n"


_PAIRS = PAIR_CTES + _cap_chain("first_lit", "")
_PAIRS_BOTH = PAIR_CTES + _cap_chain("first_both", "_b")
_MALE_SRC = """
fpm AS (select * from final f where not exists (
  select 1 from final b where b.no_order_m = 'yes' and b.male = f.male)),
"""
_F_CODES = _PAIRS + _codes_chain("final", "female", "_f")
_M_CODES = _PAIRS + _MALE_SRC + _codes_chain("fpm", "male", "_m")
_M_CODES_ANY = _PAIRS + _MALE_SRC + _codes_chain("fpm", "male", "_m", require_known=False)

_CLEAN_COLS = ("row_ord, PopID, BreedingSeason, LocationID, FemaleID, MaleID, Brood_exp, "
               "LayDate_observed, ClutchType_calculated, Num_male_partners, MaleID_known, "
               "MaleID_recode, Num_female_partners, FemaleID_known, FemaleID_recode")
_FINAL10 = "pop, nest, year, female, f_pair_num, male, m_pair_num, \"order\", no_order_f, no_order_m"
_YEARS = range(1995, 2002)


def _wide(focal: str, codes_cte: str) -> str:
    cols = ", ".join(f"max(case when year = {y} then event_code end) as \"{y}\"" for y in _YEARS)
    cols += ", max(case when year is null then event_code end) as \"NA\""
    return f"select pop, {focal}, multi_partner, {cols} from {codes_cte} where rn = 1 " \
           f"group by pop, {focal}, multi_partner"


PAIR_QUERIES: dict[str, str] = {
    "partner_multiplicity": _with(PAIR_CTES) + """
select PopID, FemaleID, BreedingSeason,
  cast(count(distinct MaleID) + max(case when MaleID is null then 1 else 0 end) as bigint) as num_partners,
  count(distinct MaleID) as num_partners_known
from brood where Species = 'PARMAJ' and (FemaleID is not null or MaleID is not null) and FemaleID is not null
group by PopID, FemaleID, BreedingSeason""",
    "partner_crosstab": _with(PAIR_CTES) + """
select PopID, num_partners, count(*) as n from (
  select PopID, FemaleID, BreedingSeason,
    cast(count(distinct MaleID) + max(case when MaleID is null then 1 else 0 end) as bigint) as num_partners
  from brood where Species = 'PARMAJ' and FemaleID is not null
  group by PopID, FemaleID, BreedingSeason) t group by PopID, num_partners""",
    "clean_pairs": _with(PAIR_CTES) + f"select {_CLEAN_COLS} from clean_pairs",
    "ordered_multi_partner": _with(PAIR_CTES) +
        f"select {_CLEAN_COLS} from clean_pairs where Num_female_partners = 2",
    "first_season_literal": _with(PAIR_CTES) + "select * from first_lit",
    "first_season_both": _with(PAIR_CTES) + "select * from first_both",
    "capture_enrichment": _with(_PAIRS) + """
select PopID, BreedingSeason, IndvID, Sex_observed, CaptureDate, Cap_exp, years, capture, row_ord
from cap_en""",
    "build_pairs": _with(_PAIRS) + """
select * exclude (nd_f, nd_m), bool_or(brood is null) over (partition by PopID, FemaleID) as extra_f,
  bool_or(brood is null) over (partition by PopID, MaleID) as extra_m from po""",
    "experiment_summary": _with(_PAIRS) + """
select PopID,
  count(distinct case when Female_exp then FemaleID end) as Females_exp,
  cast(count_if(Female_exp) as bigint) as Females_exp_y,
  count(distinct case when Male_exp then MaleID end) as Males_exp,
  cast(count_if(Male_exp) as bigint) as Males_exp_y,
  cast(count_if(Brood_exp) as bigint) as Brood_exp
from po group by PopID""",
    "final_pairs": _with(_PAIRS) + f"select {_FINAL10} from final",
    "final_pairs_both_sexes": _with(_PAIRS_BOTH) + f"select {_FINAL10} from final_b",
    "drop_unorderable_males": _with(_PAIRS, _MALE_SRC) + f"select {_FINAL10} from fpm",
    "event_codes_female": _with(_F_CODES) +
        "select pop, female, year, multi_partner, event_code from codes_f where rn = 1",
    "event_codes_male": _with(_M_CODES) +
        "select pop, male, year, multi_partner, event_code from codes_m where rn = 1",
    "event_codes_male_any_partner": _with(_M_CODES_ANY) +
        "select pop, male, year, multi_partner, event_code from codes_m where rn = 1",
    "wide_history_female": _with(_F_CODES) + _wide("female", "codes_f"),
    "wide_history_male": _with(_M_CODES) + _wide("male", "codes_m"),
}


def _r6(*cols: str) -> str:
    """``* replace (round(c, 6) as c, ...)`` for the double output columns."""
    return "* replace (" + ", ".join(f"round({c}, 6) as {c}" for c in cols) + ")"


_RECODE = ("case when ExperimentID in ('NA;NA;NA','NA','FALSE') or ExperimentID like '%control%' "
           "then null else ExperimentID end")

BREEDING_CTES = f"""
brood AS ({BROOD_VIEW_SQL}),
capture AS ({CAPTURE_VIEW_SQL}),
br AS (
  select PopID, BreedingSeason, LocationID, FemaleID, MaleID, LayDate_observed, ClutchType_calculated,
    case when ({_RECODE}) is null then 'n' else 'y' end as Experiment, row_ord
  from brood
  where Species = 'PARMAJ' and (FemaleID is not null or MaleID is not null)
    and not coalesce(FemaleID in ('0','1','1e+06'), false) and not coalesce(MaleID in ('0','1'), false)
),
records AS (
  select PopID, BreedingSeason, LocationID, FemaleID, MaleID, LayDate_observed, ClutchType_calculated,
    Experiment, min(row_ord) as row_ord
  from br group by PopID, BreedingSeason, LocationID, FemaleID, MaleID, LayDate_observed,
    ClutchType_calculated, Experiment
),
fid AS (
  select r.*,
    case when FemaleID is null then 0
         else count(distinct BreedingSeason) over (partition by PopID, FemaleID)
           + max(case when BreedingSeason is null then 1 else 0 end) over (partition by PopID, FemaleID) end as num_yrs,
    case when FemaleID is not null and MaleID is not null and lag(MaleID) over w = MaleID
              and lag(BreedingSeason) over w <> BreedingSeason then 'same'
         when FemaleID is not null and MaleID is not null and lag(MaleID) over w <> MaleID
              and lag(BreedingSeason) over w <> BreedingSeason then 'switched' end as partner,
    cast(length(FemaleID) as integer) as ncharID_F, cast(length(MaleID) as integer) as ncharID_M
  from records r
  window w as (partition by PopID, FemaleID order by BreedingSeason nulls last, LayDate_observed nulls last, row_ord)
),
rep AS (
  select PopID, BreedingSeason,
    count(distinct case when partner = 'same' then FemaleID end) as repairs,
    count(distinct case when partner is not null then FemaleID end) as tot_pairs
  from fid where ClutchType_calculated = 'first' group by PopID, BreedingSeason
),
"""

_NA_ELEM_TERM = """+ max(case when ClutchType_calculated is null
                  or (ClutchType_calculated = 'second' and LocationID is null) then 1 else 0 end) over ps"""



def _r_round(x: str, digits: int) -> str:
    """The nearest decimal to the stored double, ties to even: ``x`` scaled as the exact sum of
    two products (of its leading 24 bits, and of the rest), whose rounding error then decides
    what looks like a half."""
    scale = 10 ** digits
    parts = f"list_transform([cast({x} as double)], lambda x: {{{{'h': cast(cast(x as float) as double) * {scale}, 'l': (x - cast(cast(x as float) as double)) * {scale}}}}})"
    error = "(s.l - ((s.h + s.l) - s.h))"
    near = "round_even(s.h + s.l, 0)"
    half = f"abs(s.h + s.l - {near}) = 0.5"
    return (f"list_transform({parts}, lambda s: case when {half} and {error} > 0 then s.h + s.l + 0.5"
            f" when {half} and {error} < 0 then s.h + s.l - 0.5 else {near} end / {scale} + 0.0)[1]").replace("{{", "{").replace("}}", "}")


_COR = _r_round("""case when regr_sxx(ry, rx) > 0 and regr_syy(ry, rx) > 0
      then regr_sxy(ry, rx) / sqrt(regr_sxx(ry, rx) * regr_syy(ry, rx)) end""", 2)

FLEDGE_CTES_T = f"""
brood AS ({BROOD_VIEW_SQL}),
fin AS (
  select Species, PopID, BreedingSeason, LocationID, FemaleID, MaleID, ClutchType_calculated,
    LayDate_observed, cast(coalesce(NumberFledged_observed, NumberFledged) as integer) as NumberFledged
  from brood where Species = 'PARMAJ' and ({_RECODE}) is null
),
fm0 AS (
  select *,
    avg(case when ClutchType_calculated = 'first' then NumberFledged end) over ps as first_clutch_avg,
    avg(case when ClutchType_calculated in ('second','replacement') then NumberFledged end) over ps
      as second_clutch_avg,
    count(distinct case when ClutchType_calculated = 'second' then LocationID end) over ps
      {{_NA_ELEM}}
      as second_n,
    count(*) over ps as clutches_,
    case when FemaleID is not null and FemaleID not in ('0','1','1e+06')
         then sum(NumberFledged) over (partition by PopID, BreedingSeason, FemaleID) end as tot_fledged_fem,
    sum(NumberFledged) over (partition by PopID, BreedingSeason, LocationID) as tot_fledged_nest
  from fin window ps as (partition by PopID, BreedingSeason)
),
fm AS (
  select PopID, BreedingSeason, max(clutches_) as clutches,
    max(second_n) / max(clutches_) as prop_second_clutch,
    coalesce(max(first_clutch_avg), 0) + coalesce(max(second_clutch_avg), 0) as avg_sum_clutch,
    count(distinct FemaleID) as females, avg(tot_fledged_fem) as fledge_fem_avg,
    count(distinct LocationID) as nests, avg(tot_fledged_nest) as fledge_nest_avg
  from fm0 group by PopID, BreedingSeason
),
metrics AS (
  select *, {_r_round("avg(fledge_ratio) over (partition by PopID)", 2)} as fledge_ratio_avg
  from (select *, females / clutches as fem_clutch_ratio,
          case when fledge_nest_avg = 0 then null else fledge_fem_avg / fledge_nest_avg end as fledge_ratio
        from fm) x
),
adj1 AS (
  select *, prop_NA > 0.5 as pooled, case when prop_NA > 0.5 then null else PopID end as fit_key
  from (select *, count(*) filter (where fledge_ratio is null) over (partition by PopID)
                  / count(*) over (partition by PopID) as prop_NA from metrics) x
),
fits AS (
  select fit_key, regr_slope(fledge_ratio, prop_second_clutch) as b,
    regr_intercept(fledge_ratio, prop_second_clutch) as a,
    regr_avgy(fledge_ratio, prop_second_clutch) as ay, regr_sxx(fledge_ratio, prop_second_clutch) as sxx
  from adj1 group by fit_key
),
adj AS (
  select a1.* exclude (fit_key),
    case when f.sxx > 0 then f.a + f.b * a1.prop_second_clutch else f.ay end as fledge_ratio_pred,
    fledge_nest_avg * (case when f.sxx > 0 then f.a + f.b * a1.prop_second_clutch else f.ay end)
      as fledge_nest_avg_adj
  from adj1 a1 left join fits f on a1.fit_key is not distinct from f.fit_key
),
cor0 AS (
  select PopID, BreedingSeason, fledge_fem_avg as x, fledge_nest_avg_adj as y from adj
  where fledge_fem_avg is not null and fledge_nest_avg_adj is not null
),
ranked AS (
  select PopID, BreedingSeason,
    rank() over (partition by PopID order by x) + (count(*) over (partition by PopID, x) - 1) / 2.0 as rx,
    rank() over (partition by PopID order by y) + (count(*) over (partition by PopID, y) - 1) / 2.0 as ry
  from cor0
),
agree AS (
  select PopID,
    {_COR} as cor,
    count(distinct BreedingSeason) + max(case when BreedingSeason is null then 1 else 0 end) as count
  from ranked group by PopID
),
std AS (
  select PopID, BreedingSeason, fledge_nest_avg_adj as pop_year_fledge_avg,
    avg(fledge_nest_avg_adj) over p as pop_tot_fledge_avg,
    stddev_samp(fledge_nest_avg_adj) over p as pop_tot_fledge_sd,
    (fledge_nest_avg_adj - avg(fledge_nest_avg_adj) over p)
      / nullif(stddev_samp(fledge_nest_avg_adj) over p, 0) as envStd_fledge_num
  from adj window p as (partition by PopID)
),
"""
FLEDGE_CTES = FLEDGE_CTES_T.replace("{_NA_ELEM}", _NA_ELEM_TERM)
FLEDGE_CTES_NO_NA = FLEDGE_CTES_T.replace("{_NA_ELEM}", "")


def _change(src: str) -> str:
    return f"""
select PopID, BreedingSeason, round(envStd_fledge_num, 6) as envStd_fledge_num,
  round((d - avg(d) over p) / nullif(stddev_samp(d) over p, 0), 6) as Ztrans_envStd_fledge_num_lag
from (select *, abs(envStd_fledge_num - lag(envStd_fledge_num)
                    over (partition by PopID order by BreedingSeason nulls last)) as d from {src}) x
window p as (partition by PopID)"""


_METRIC_COLS = ("prop_second_clutch", "avg_sum_clutch", "fledge_fem_avg", "fledge_nest_avg",
                "fem_clutch_ratio", "fledge_ratio", "fledge_ratio_avg")
_STD_COLS = ("pop_year_fledge_avg", "pop_tot_fledge_avg", "pop_tot_fledge_sd", "envStd_fledge_num")

OTHER_QUERIES: dict[str, str] = {
    "breeding_records": _with(BREEDING_CTES) + "select * from records",
    "partner_fidelity": _with(BREEDING_CTES) + "select * from fid",
    "repair_rate": _with(BREEDING_CTES) + """
select PopID, BreedingSeason, repairs, tot_pairs,
  round(case when tot_pairs = 0 then null else repairs / tot_pairs end, 6) as repair_prop
from (select *, sum(repairs) over (partition by PopID) as all_repairs from rep) x where all_repairs > 0""",
    "capture_records": _with(f"capture AS ({CAPTURE_VIEW_SQL}),") + """
select CapturePopID, IndvID, BreedingSeason, Age_calculated, Experiment from (
  select *, case when bool_or(ExperimentID is not null) over (partition by BreedingSeason, IndvID)
                 then 'y' else 'n' end as Experiment,
    row_number() over (partition by IndvID, BreedingSeason order by row_ord) as rn
  from capture where Species = 'PARMAJ') x
where rn = 1 and CapturePopID is not null and IndvID is not null and BreedingSeason is not null
  and Age_calculated is not null""",
    "fledge_metrics": _with(FLEDGE_CTES) + f"select {_r6(*_METRIC_COLS)} from metrics",
    "fledge_metrics_ignore_na": _with(FLEDGE_CTES_NO_NA) + f"select {_r6(*_METRIC_COLS)} from metrics",
    "fledge_adjusted": _with(FLEDGE_CTES) +
        f"select {_r6(*_METRIC_COLS, 'prop_NA', 'fledge_ratio_pred', 'fledge_nest_avg_adj')} from adj",
    "fledge_line_by_group": _with(FLEDGE_CTES) + """
select PopID,
  round(case when regr_sxx(fledge_ratio, prop_second_clutch) > 0
    then regr_intercept(fledge_ratio, prop_second_clutch)
    else regr_avgy(fledge_ratio, prop_second_clutch) end, 6) as intercept,
  round(case when regr_sxx(fledge_ratio, prop_second_clutch) > 0
    then regr_slope(fledge_ratio, prop_second_clutch) end, 6) as slope,
  cast(regr_count(fledge_ratio, prop_second_clutch) as bigint) as n
from metrics group by PopID""",
    "metric_agreement": _with(FLEDGE_CTES) + "select PopID, round(cor, 6) as cor, count from agree",
    "metric_agreement_overall": _with(FLEDGE_CTES) + """
select round(sum(case when cor is not null then cor * count end)
  / nullif(sum(case when cor is not null then count end), 0), 6) as weighted_cor from agree""",
    "fledge_standardised": _with(FLEDGE_CTES) + f"select {_r6(*_STD_COLS)} from std",
    "fledge_change": _with(FLEDGE_CTES) + _change("std"),
    "fledge_change_skip_missing": _with(FLEDGE_CTES) + _change(
        "(select * from std where PopID is not null and BreedingSeason is not null and pop_year_fledge_avg is not null and pop_tot_fledge_avg is not null"
        " and pop_tot_fledge_sd is not null and envStd_fledge_num is not null)"),
    "metric_long": _with(FLEDGE_CTES) + """
select PopID, BreedingSeason, 'fledge_fem_avg' as metric, round(fledge_fem_avg, 6) as value from adj
union all select PopID, BreedingSeason, 'fledge_nest_avg', round(fledge_nest_avg, 6) from adj
union all select PopID, BreedingSeason, 'fledge_nest_avg_adj', round(fledge_nest_avg_adj, 6) from adj""",
    "metric_diff_long": _with(FLEDGE_CTES) + """
select PopID, BreedingSeason, round(diff_diff, 6) as diff_diff, metric, round(value, 6) as value from (
  select PopID, BreedingSeason, (fledge_fem_avg - fledge_nest_avg_adj) - (fledge_fem_avg - fledge_nest_avg)
      as diff_diff, 'raw_diff' as metric, fledge_fem_avg - fledge_nest_avg as value from adj
  union all
  select PopID, BreedingSeason, (fledge_fem_avg - fledge_nest_avg_adj) - (fledge_fem_avg - fledge_nest_avg),
      'adj_diff', fledge_fem_avg - fledge_nest_avg_adj from adj) x""",
    "low_female_coverage": _with(FLEDGE_CTES) + """
select PopID, BreedingSeason, round(fledge_nest_avg, 6) as fledge_nest_avg,
  round(fledge_fem_avg, 6) as fledge_fem_avg, round(fem_clutch_ratio, 6) as fem_clutch_ratio
from adj where fledge_fem_avg is not null and fledge_nest_avg_adj is not null and fem_clutch_ratio < 0.5""",
    "coverage_by_clutch": _with(FLEDGE_CTES) + """
select PopID, ClutchType_calculated, count(*) as tot_obs, count(FemaleID) as female_id,
  round(count(FemaleID) / count(*), 6) as perc_id
from fin group by PopID, ClutchType_calculated""",
    "nests_females_per_year": _with(FLEDGE_CTES) + """
select PopID, BreedingSeason, count(distinct LocationID) as nests, count(distinct FemaleID) as fems
from fin group by PopID, BreedingSeason""",
}

_OVERVIEW = """
pops AS (select distinct PopID as pop_code from brood where PopID is not null union all select 'NODATA'),
done AS (select distinct PopID from fin where PopID is not null),
"""
OTHER_QUERIES["population_overview"] = _with(FLEDGE_CTES, _OVERVIEW) + """
select a.PopID, a.num_pairs, b.num_years, d.done from
  (select PopID, count(*) as num_pairs from (select distinct PopID, MaleID, FemaleID from brood
     where MaleID is not null and FemaleID is not null) x group by PopID) a
  join (select PopID, case when count(BreedingSeason) = count(*)
          then cast(max(BreedingSeason) + 1 - min(BreedingSeason) as integer) end as num_years
        from brood where MaleID is not null and FemaleID is not null group by PopID) b
    on a.PopID is not distinct from b.PopID
  left join (select p.pop_code as PopID, dd.done from pops p
             left join (select distinct PopID, 'yes' as done from done) dd on p.pop_code = dd.PopID) d
    on a.PopID = d.PopID"""
OTHER_QUERIES["populations_missing"] = _with(FLEDGE_CTES, _OVERVIEW) + \
    "select pop_code from pops where pop_code not in (select PopID from done)"


OTHER_QUERIES["pair_diagnostics"] = _with(_PAIRS) + """
, yrs_d AS (select distinct pop, year from final),
mal_d AS (select distinct pop, male from final where male is not null),
g_d AS (
  select pop, year, female, male, row_ord from final where male is not null
  union all
  select m.pop, y.year, null, m.male, null from mal_d m join yrs_d y on m.pop is not distinct from y.pop
  where not exists (select 1 from final f where f.pop is not distinct from m.pop and f.male = m.male
                    and f.year is not distinct from y.year)
),
l_d AS (select *, lag(female) over (partition by pop, male order by year nulls last, row_ord nulls last)
          as prev_partner from g_d)
select pop, year, female, male, row_ord, prev_partner, male is not null as prev_partner_known_pair,
  case when female is not null then lag(year) over (partition by pop, female order by prev_partner nulls last,
    year nulls last, male nulls last, row_ord nulls last) is not null end as breeding_previous_year,
  case when female is not null and male is not null and lag(female) over w2 is not null
            and male = lag(male) over w2 then true
       when female is not null and male is not null and lag(female) over w2 is not null
            and male <> lag(male) over w2 then false end as same_female_partner
from l_d
window w2 as (partition by pop, female, year order by prev_partner nulls last, male nulls last,
              row_ord nulls last)"""


OTHER_QUERIES["csv_breeding_records"] = _with(BREEDING_CTES) + """
select row_number() over (order by PopID nulls last, BreedingSeason nulls last, FemaleID nulls last,
  LayDate_observed nulls last, row_ord) as row, * from records"""
OTHER_QUERIES["csv_pair_table"] = _with(_PAIRS) + \
    f"select * replace (concat('\"', nest, '\", \"x\"\"') as nest) from (select {_FINAL10} from final where nest is not null)" \
    f" union all select {_FINAL10} from final where nest is null"
OTHER_QUERIES["csv_histories_female"] = PAIR_QUERIES["event_codes_female"]
_REMARKS = f"""
select row_ord, PopID, case row_ord % 8 when 0 then null when 1 then '' when 2 then 'NA'
  when 3 then 'ring lost' || chr(10) || '"second" visit, box ' || LocationID
  when 4 then '"' || chr(10) || chr(10) || LocationID || '",' || chr(10)
  when 5 then chr(13) || chr(10) || LocationID || chr(13) || chr(10) || ','
  when 6 then '""' || LocationID else 'box ' || LocationID end as remark
from ({BROOD_VIEW_SQL}) b"""
# read.csv takes NA as missing, read_csv also the empty field
OTHER_QUERIES["csv_remarks"] = f"""
select 'base' as reader, row_ord, PopID, nullif(remark, 'NA') as remark from ({_REMARKS}) t
union all select 'readr', row_ord, PopID, case when remark not in ('NA', '') then remark end from ({_REMARKS}) t"""

OTHER_QUERIES["rounded_means"] = f"""
with m as (
  select PopID, BreedingSeason, LocationID, avg(cast(NumberFledged_observed as double)) as mean
  from ({BROOD_VIEW_SQL}) b group by PopID, BreedingSeason, LocationID
)
select PopID, BreedingSeason, LocationID, {_r_round("mean", 1)} as one, {_r_round("mean", 2)} as two,
  {_r_round("mean / 2", 2)} as half, {_r_round("mean * 0.1::double", 2)} as tenth
from m"""

_LAY = f"""brood AS ({BROOD_VIEW_SQL}),
lay AS (
  select row_ord, PopID, BreedingSeason, ClutchType_calculated, dayofyear(LayDate_observed) as lay_day,
    cast(coalesce(NumberFledged_observed, NumberFledged) as double) as fledged
  from brood where Species = 'PARMAJ' and ({_RECODE}) is null
),
"""
OTHER_QUERIES["lay_day_rank_correlation"] = _with(_LAY + """
ranked AS (
  select PopID,
    rank() over (partition by PopID order by lay_day) + (count(*) over (partition by PopID, lay_day) - 1) / 2.0 as rx,
    rank() over (partition by PopID order by fledged) + (count(*) over (partition by PopID, fledged) - 1) / 2.0 as ry
  from lay where lay_day is not null and fledged is not null
),
""") + """
select PopID, round(case when regr_sxx(ry, rx) > 0 and regr_syy(ry, rx) > 0
    then regr_sxy(ry, rx) / sqrt(regr_sxx(ry, rx) * regr_syy(ry, rx)) end, 6) as spearman, count(*) as n
from ranked group by PopID"""

# two predictors in closed form
_MODEL = _LAY + """
co AS (
  select PopID, count(*) as n, avg(lay_day) as m1, avg(BreedingSeason) as m2, avg(fledged) as my,
    var_pop(lay_day) * count(*) as s11, var_pop(BreedingSeason) * count(*) as s22, var_pop(fledged) * count(*) as syy,
    covar_pop(lay_day, BreedingSeason) * count(*) as s12, covar_pop(lay_day, fledged) * count(*) as s1y,
    covar_pop(BreedingSeason, fledged) * count(*) as s2y
  from lay where lay_day is not null and BreedingSeason is not null and fledged is not null group by PopID
),
slopes AS (
  select *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) as b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) as b2,
    s22 / (s11 * s22 - s12 * s12) as i11, s11 / (s11 * s22 - s12 * s12) as i22, -s12 / (s11 * s22 - s12 * s12) as i12
  from co
),
model AS (
  select *, my - b1 * m1 - b2 * m2 as b0, n - 3 as df,
    case when n > 3 then sqrt((syy - b1 * s1y - b2 * s2y) / (n - 3)) end as sigma from slopes
),
"""
OTHER_QUERIES["fledge_model"] = _with(_MODEL + """
terms AS (
  select PopID, n, df, sigma, '(Intercept)' as term, b0 as estimate,
    sigma * sqrt(1.0::double / n + m1 * m1 * i11 + 2 * m1 * m2 * i12 + m2 * m2 * i22) as std_error from model
  union all select PopID, n, df, sigma, 'lay_day', b1, sigma * sqrt(i11) from model
  union all select PopID, n, df, sigma, 'BreedingSeason', b2, sigma * sqrt(i22) from model
),
""") + """
select PopID, term, round(estimate, 6) as estimate, round(std_error, 6) as std_error,
  round(estimate / std_error, 6) as t_value, n, cast(df as bigint) as df_residual, round(sigma, 6) as sigma
from terms"""
OTHER_QUERIES["fledge_model_predictions"] = _with(_MODEL) + """
select row_ord, round(b0 + b1 * lay_day + b2 * BreedingSeason, 6) as fit,
  round(sigma * sqrt(1.0::double / n + (lay_day - m1) * (lay_day - m1) * i11
    + 2 * (lay_day - m1) * (BreedingSeason - m2) * i12 + (BreedingSeason - m2) * (BreedingSeason - m2) * i22), 6) as fit_se
from lay left join model on lay.PopID is not distinct from model.PopID"""
# a factor alone: differences of group means; without the first level the last one is the base
OTHER_QUERIES["fledge_by_clutch_type"] = _with(_LAY + """
cells AS (
  select PopID, ClutchType_calculated as level, count(*) as n, avg(fledged) as m, var_pop(fledged) * count(*) as ss
  from lay where ClutchType_calculated is not null and fledged is not null group by PopID, ClutchType_calculated
),
levels AS (select distinct ClutchType_calculated as level from lay where ClutchType_calculated is not null),
least AS (select min(level) as level from levels),
pops AS (
  select PopID, sum(n) as n, sum(n) - count(*) as df, sqrt(sum(ss) / nullif(sum(n) - count(*), 0)) as sigma,
    case when bool_or(level = (select level from least)) then (select level from least) else max(level) end as base
  from cells group by PopID
),
terms AS (
  select p.*, '(Intercept)' as term, c.m as estimate, p.sigma * sqrt(1.0::double / c.n) as std_error
  from pops p join cells c on c.PopID is not distinct from p.PopID and c.level = p.base
  union all
  select p.*, 'ClutchType_calculated' || l.level, c.m - b.m, p.sigma * sqrt(1.0::double / c.n + 1.0::double / b.n)
  from pops p cross join levels l join cells b on b.PopID is not distinct from p.PopID and b.level = p.base
  left join cells c on c.PopID is not distinct from p.PopID and c.level = l.level and l.level <> p.base
  where l.level <> (select level from least)
),
""") + """
select PopID, term, round(estimate, 6) as estimate, round(std_error, 6) as std_error,
  round(estimate / nullif(std_error, 0), 6) as t_value, cast(n as bigint) as n, cast(df as bigint) as df_residual, round(sigma, 6) as sigma
from terms"""
_T = ", ".join(repr(t_quantile(k)) for k in range(1, EXACT_T + 1))
OTHER_QUERIES["fledge_trend_band"] = _with(FLEDGE_CTES + """
co AS (
  select PopID, count(*) as n, avg(prop_second_clutch) as mx, avg(fledge_ratio) as my,
    var_pop(prop_second_clutch) * count(*) as sxx, covar_pop(prop_second_clutch, fledge_ratio) * count(*) as sxy,
    var_pop(fledge_ratio) * count(*) as syy
  from metrics where prop_second_clutch is not null and fledge_ratio is not null group by PopID
),
fitted AS (
  select *, case when sxx > 0 then n - 2 else n - 1 end as df, case when sxx > 0 then sxy / sxx else 0 end as b from co
),
band AS (
  select m.PopID, m.BreedingSeason, m.prop_second_clutch, my + b * (prop_second_clutch - mx) as fit, df,
    sqrt((syy - b * sxy) / nullif(df, 0)) * sqrt(1.0::double / n + case when sxx > 0 then (prop_second_clutch - mx) * (prop_second_clutch - mx) / sxx else 0 end) as se
  from metrics m left join fitted f on m.PopID is not distinct from f.PopID
),
""") + f"""
select PopID, BreedingSeason, round(prop_second_clutch, 6) as prop_second_clutch, round(fit, 6) as fit,
  round(fit - [{_T}][df] * se, 6) as fit_low, round(fit + [{_T}][df] * se, 6) as fit_high from band"""

OTHER_QUERIES["event_codes_by_season"] = PAIR_QUERIES["event_codes_female"]
OTHER_QUERIES["lay_density"] = _with(_LAY + """
known AS (select PopID, ClutchType_calculated, cast(lay_day as double) as v from lay where lay_day is not null),
g AS (
  select PopID, ClutchType_calculated, count(*) as n, min(v) as low, max(v) as high, stddev_samp(v) as sd,
    (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34::double as iqr
  from known group by PopID, ClutchType_calculated having count(*) > 1
),
h AS (
  select *, 0.9::double * case when least(sd, iqr) > 0 then least(sd, iqr) when sd > 0 then sd when abs(low) > 0 then abs(low) else 1 end
    * pow(n, -0.2::double) as bandwidth from g
),
grid AS (
  select h.*, low - 3 * bandwidth + (high - low + 6 * bandwidth) * i / 511 as x from h, range(512) as r(i)
),
bins AS (select PopID, ClutchType_calculated, v, count(*) as k from known group by PopID, ClutchType_calculated, v),
""") + """
select grid.PopID, grid.ClutchType_calculated, any_value(n) as n, round(any_value(bandwidth), 9) as bandwidth, round(x, 9) as x,
  round(sum(k * exp(-0.5::double * pow((x - v) / bandwidth, 2))) / (any_value(n) * any_value(bandwidth) * sqrt(2 * pi())), 9) as density
from grid join bins on bins.PopID is not distinct from grid.PopID and bins.ClutchType_calculated is not distinct from grid.ClutchType_calculated
group by grid.PopID, grid.ClutchType_calculated, x"""
OTHER_QUERIES["previous_capture"] = f"""
select row_ord, CapturePopID, lag(CaptureDate) over w as previous_date, lag(IndvID) over w as previous_bird,
  cast(CaptureDate - lag(CaptureDate) over w as integer) as days
from ({CAPTURE_VIEW_SQL}) c window w as (partition by CapturePopID order by CaptureDate nulls last, row_ord)"""
OTHER_QUERIES["nearest_capture"] = f"""
with nests as (select row_ord, upper(FemaleID) as bird, LayDate_observed as day from ({BROOD_VIEW_SQL}) b),
caught as (select distinct upper(IndvID) as bird, CaptureDate as day from ({CAPTURE_VIEW_SQL}) c where IndvID is not null and CaptureDate is not null),
near as (
  select n.row_ord, arg_min(c.day, (abs(n.day - c.day), c.day)) as nearest from nests n join caught c on c.bird = n.bird and n.day is not null
  group by n.row_ord
)
select n.row_ord, n.bird, n.day as lay_date, near.nearest, cast(n.day - near.nearest as integer) as days
from nests n left join near on near.row_ord = n.row_ord"""


def oracle_queries() -> dict[str, str]:
    out = dict(PAIR_QUERIES)
    out.update(OTHER_QUERIES)
    return out

"""Record linkage and discrepancy analytics on PySpark."""

from kinmatch.functions.similarity import league_similarity, similarity, team_similarity
from kinmatch.functions.text import fold, league_name, split_league_qualifiers, split_qualifiers, tokens
from kinmatch.functions.timeutil import compare_times, epoch_ms, local_from_ms, local_from_seconds, parse_local, shifted_day, stamp
from kinmatch.operators.aliases import Aliases, canonical_sport, enabled_sports, sport_by_id, sport_by_key, sport_of
from kinmatch.operators.collect import collect_events, upsert
from kinmatch.operators.matching import Options, assign, candidate_pairs, cluster, compare_leagues, compare_teams, confidence, match_pairs, score_pairs, unmatched, with_features
from kinmatch.operators.report import analyse, discrepancies, report_tree
from kinmatch.plans.compare import Comparison, compare_files, compare_listings, envelope

__all__ = [
    "Aliases", "Comparison", "Options", "analyse", "assign", "candidate_pairs", "canonical_sport", "cluster", "collect_events", "compare_files", "compare_leagues", "compare_listings", "compare_teams",
    "compare_times", "confidence", "discrepancies", "enabled_sports", "envelope", "epoch_ms", "fold", "league_name", "league_similarity", "local_from_ms", "local_from_seconds", "match_pairs", "parse_local",
    "report_tree", "score_pairs", "shifted_day", "similarity", "split_league_qualifiers", "split_qualifiers", "sport_by_id", "sport_by_key", "sport_of", "stamp", "team_similarity", "tokens", "unmatched",
    "upsert", "with_features",
]

"""Vocabularies of argument graphs. All values here are fixed: they must equal those of the data model."""

# Node types, relation types, default schemes.
NODE_TYPES = ["I", "L", "RA", "CA", "MA", "YA", "TA"]
RELATION_TYPES = ["RA", "CA", "MA"]
DEFAULT_SCHEMES = {"RA": "Default Inference", "CA": "Default Conflict", "MA": "Default Rephrase", "TA": "Default Transition", "YA": "Default Illocuting"}
# Illocutionary forces, those of locutions, those of transitions, and their families.
FORCES = ["Asserting", "Arguing", "Restating", "Analysing", "Agreeing", "Disagreeing", "PureQuestioning", "AssertiveQuestioning", "RhetoricalQuestioning", "Challenging", "Default Illocuting"]
LOCUTION_FORCES = ["Asserting", "PureQuestioning", "AssertiveQuestioning", "RhetoricalQuestioning", "Challenging", "Agreeing", "Disagreeing", "Default Illocuting"]
TRANSITION_FORCES = ["Arguing", "Restating", "Disagreeing", "Challenging", "Analysing", "Default Illocuting"]
FAMILIES = {
    "assertive": ["Asserting", "Arguing", "Restating", "Analysing", "Default Illocuting"],
    "interrogative": ["PureQuestioning", "AssertiveQuestioning", "RhetoricalQuestioning", "Challenging"],
    "responsive": ["Agreeing", "Disagreeing"],
}
# Grade ladders (best first), distance bands, thresholds of the proposition curve.
LADDERS = [["5", "4", "3", "2", "1"], ["high", "medium", "low"]]
BANDS = ["1", "2-4", "5-9", "10+"]
THRESHOLDS = [0.3, 0.4, 0.5, 0.55, 0.6, 0.7, 0.8, 0.9]
MIN_SIMILARITY = 0.55
# Versions of the edit distance, weights, costs.
METRICS = ["0.1", "0.2", "0.3", "0.4"]
NODE_COST = {"uniform": {}, "ya-ta-discounted": {"YA": 0.5, "TA": 0.5}}
EDGE_COST, RELATION_MISMATCH, FAMILY_MATCH, FORCE_MISMATCH, FORBIDDEN, TYPE_MISMATCH, DIRECTION_MISMATCH = 1.0, 0.75, 0.5, 1.0, 1e6, 0.75, 1.0
# The eleven costs of the learnable distance, their order and starting point, and the knots of substitution.
PARAMETERS = ["node_missing", "node_extra", "sub_0.9", "sub_0.7", "sub_0.5", "sub_0.3", "edge_missing", "type_ra_ca", "type_ra_ma", "type_ca_ma", "direction"]
THETA = [1.0, 1.0, 0.1, 0.2, 0.2, 0.2, 1.0, 0.75, 0.75, 0.75, 1.0]
KNOTS = [1.0, 0.9, 0.7, 0.5, 0.3]
EDGE_EXTRA = 1.0



from posewright.plans import arena_motion, audio, classic_queries, enrichment, event_queries, harness, highlights, overlays, perception_queries, pose_queries, pressure_queries, tracking

MODULES = (event_queries, pose_queries, perception_queries, pressure_queries, classic_queries, arena_motion, audio, enrichment, tracking, harness, overlays, highlights)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}

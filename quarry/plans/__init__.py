"""The model: join graph, query payloads, recorder and planner."""

"""Feature, forecast, metric and selection operators over panels."""

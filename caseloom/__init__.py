"""caseloom: incident and complaint analytics as plain DataFrame -> DataFrame operators."""

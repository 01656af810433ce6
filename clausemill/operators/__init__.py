"""DataFrame -> DataFrame operators of the policy-text engine."""

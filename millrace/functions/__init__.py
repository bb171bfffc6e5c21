"""Expressions on addresses, domains, policies, codes and times."""

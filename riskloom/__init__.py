"""Behavioural risk features over login and transaction logs, on Spark."""

"""Training-data operators: quality, decontamination, deduplication, mixing, licences, rules and language."""

from lexiflow.session import ship_by_value

ship_by_value()

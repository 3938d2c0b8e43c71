"""Training-data operators: each module has one operator; queries.py registers them."""

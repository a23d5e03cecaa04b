"""Training-data operators: ten document, page and conversation operators and the queries that apply them."""

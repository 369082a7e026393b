"""lorebank.sources"""

"""lorebank.operators"""

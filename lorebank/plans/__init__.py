"""lorebank.plans"""
